"""Token ids of a byte-level BPE file, by the tokenizers library, with a bounded cache of words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Words of a generation. A worker keeps the ids of two: when one is full, the words that weren't asked for in it are forgotten.
WORDS = 250_000
#: Words that the library merges in one call.
JOINED = 50
#: Characters that are split at once, about.
STEP = 1 << 20

_SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
#: Classes of bytes. Those of a letter beyond ASCII are LETTER, of other such characters OTHER.
OTHER, LETTER, DIGIT, SIGN, QUOTE, SPACE, LINE, BLANK, UNKNOWN = range(9)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for c in range(0x21, 0x7F):
        out[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
    out[0x27], out[0x20], out[0x0A] = QUOTE, SPACE, LINE
    out[[0x09, 0x0B, 0x0C, 0x0D]] = BLANK
    return out


def _cuts() -> np.ndarray:
    """By 8 * class + class of the next byte: whether the library's splitter cuts between them, whatever is around. Behind a line break that holds if no white space is before it."""
    out = np.zeros(64, bool)
    solid, white = (LETTER, DIGIT, SIGN, QUOTE), (SPACE, LINE, BLANK)
    for x in solid:
        for y in solid:
            out[8 * x + y] = x != y and x != QUOTE and (x, y) != (SIGN, QUOTE)
        for y in white:
            out[8 * x + y] = True
        out[8 * LINE + x] = True
    return out


_CLASS, _CUT = _classes(), _cuts()


def _byte_letters() -> dict[int, str]:
    """The rule by which byte-level vocabularies spell bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
_BYTES = {v: k for k, v in _LETTERS.items()}
_SPACE, _LINE = _LETTERS[0x20], _LETTERS[0x0A]
_encoders: dict[tuple[str, bool], Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(c: str) -> str:
    if c in " \n":
        return "space" if c == " " else "line"
    if "!" <= c <= "~" and not c.isalpha():
        return "digit" if c.isdigit() else "sign"
    return "letter" if c.isalpha() or "\udc80" <= c <= "\udcff" else "other"


def _crosses(token: str) -> bool:
    """Whether a token could join what the splitter keeps apart in a run of plain words."""
    if any(c not in _BYTES for c in token):
        return False
    chars = bytes(_BYTES[c] for c in token).decode("utf-8", "surrogateescape")
    kinds = {_class(c) for c in (chars[1:] if chars[:1] == " " else chars)}
    return len(kinds) > 1 and "other" not in kinds and "'" not in chars


class Encoder:
    """encode(text) gives the ids that the library gives for the whole text.

    Texts are cut into words where the library's splitter cuts in any case
    (between letters, digits and signs, before a white space, behind a single
    line break); a single space starts the next word. What is a letter beyond
    ASCII is asked of the splitter itself. Each distinct word is given to the
    library once. Those of one class, perhaps behind a space, go to its model,
    many in a call: they don't mix in it, as no token of the vocabulary has two
    classes of characters or a space within (checked when the file is read;
    otherwise each word is encoded on its own). All others are encoded by
    themselves. Special strings are cut out first, as the library does; with
    ``special=False`` they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder() if special else {}
        self.added = {t.content: i for i, t in added.items()}
        self.simple = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        self.marks = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.joins = not any(map(_crosses, vocab))
        self.heads = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.heads[[i for t, i in vocab.items() if t.startswith(_SPACE)]] = True
        self.line = self.model.token_to_id(_LINE)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        self.known: dict = {}
        self.older: dict = {}

    def _recall(self, words: list[str]) -> list[str]:
        """The words that the older generation hasn't either; the others are taken over."""
        if not self.older:
            return words
        got = list(map(self.older.get, words))
        self.known.update([(word, ids) for word, ids in zip(words, got, strict=True) if ids is not None])
        return [word for word, ids in zip(words, got, strict=True) if ids is None]

    def _tokens(self, words: list[str], mark: str) -> np.ndarray:
        """The model's ids of plain words, each behind a space or line break, which is the first character of some token and within none."""
        ids: list[int] = []
        for at in range(0, len(words), JOINED):
            run = mark + mark.join(words[at : at + JOINED])
            run = run.replace(mark, _LETTERS[ord(mark)]) if run.isascii() else run.encode().decode("latin-1").translate(_LETTERS)
            ids += [t.id for t in self.model.tokenize(run)]
        return np.array(ids, np.uint32)

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, skip: int) -> None:
        if len(starts) != len(words):
            raise ValueError("words and ids don't fit")
        raw, at = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
        self.known.update(zip(words, [raw[a + skip : b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))

    def _merge(self, words: list[str]) -> None:
        """Learns plain words, each behind a space."""
        ids = self._tokens(words, " ")
        self._keep([" " + w for w in words], ids, np.flatnonzero(self.heads[ids]), 0)

    def _merge_bare(self, words: list[str]) -> None:
        """Learns plain words without a space: a line break, whose id is dropped, keeps them apart."""
        ids = self._tokens(words, "\n")
        self._keep(words, ids, np.flatnonzero(ids == self.line), 4)

    def _alone(self, word: str) -> None:
        """Learns a word by itself."""
        self.known[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, words: list[str], odd: set[str]) -> None:
        """Learns new words. Those that aren't odd are of one class, perhaps behind a space."""
        plain = [w for w in words if w not in odd] if self.joins and self.line is not None else []
        if len(plain) < len(words):
            for word in [w for w in words if w in odd] if plain else words:
                self._alone(word)
        ascii_only = list(map(str.isascii, plain))
        for kind in (True, False):  # runs of ASCII words are quicker to spell
            some = [w for w, own in zip(plain, ascii_only, strict=True) if own is kind]
            self._merge([w[1:] for w in some if w[0] == " "])
            self._merge_bare([w for w in some if w[0] != " "])

    def _classes(self, raw: np.ndarray) -> np.ndarray:
        """The class of each byte of whole characters."""
        out = _CLASS[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            first = raw[lead].astype(np.int32)
            more = 1 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0x3F >> more)
            for k in (1, 2, 3):
                on = more >= k
                code[on] = code[on] << 6 | raw[lead[on] + k] & 0x3F
            for c in np.unique(code[self.kinds[code] == UNKNOWN]).tolist():
                self.kinds[c] = LETTER if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}a")) == 1 else OTHER
            letter = self.kinds[code] == LETTER
            for k in (0, 1, 2, 3):
                out[lead[letter & (more >= k)] + k] = LETTER
        return out

    def _words(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start in the bytes of texts that start at ``begins``, and which of them are odd."""
        kind = self._classes(raw)
        head = np.empty(len(raw), bool)
        head[1:] = _CUT[kind[:-1] << 3 | kind[1:]]
        white = (kind >= SPACE) & (kind <= BLANK)
        lines = np.flatnonzero(kind == LINE)
        run = lines[(lines > 0) & (white | (kind == OTHER))[lines - 1]]
        head[run[run + 1 < len(raw)] + 1] = False
        head[begins] = True
        starts = np.flatnonzero(head)
        # a plain word is of letters, digits or signs with at most a space before them, or one line break
        bad = (kind == OTHER) | (kind == QUOTE) | (kind == BLANK) | (kind == LINE)
        bad[1:] |= white[1:] & ~head[1:]  # white space within
        bad[:-1] |= (kind[:-1] == SPACE) & head[1:]  # a space alone
        bad[-1:] |= kind[-1:] == SPACE
        odd = np.zeros(len(starts), bool)
        odd[np.searchsorted(starts, np.flatnonzero(bad), side="right") - 1] = True
        return starts, odd

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special strings."""
        if len(self.known) >= WORDS:
            self.known, self.older = {}, self.known
        parts = [t.encode() for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        joined = b"".join(parts)
        if not joined:
            return [np.zeros(0, np.uint32)] * len(texts)
        raw, begins = np.frombuffer(joined, np.uint8), np.append(0, ends[:-1])
        starts, odd = self._words(raw, begins[begins < len(raw)])
        coded = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(joined)]).dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, words))
        if None in got:
            missing = [i for i, ids in enumerate(got) if ids is None]
            self._learn(self._recall([words[i] for i in missing]), {words[i] for i in np.unique(which[odd]).tolist()})
            for i in missing:
                got[i] = self.known[words[i]]
        flat = np.frombuffer(b"".join(got), np.uint32)
        n = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        size = n[which]
        after = np.cumsum(size)
        shift = (np.cumsum(n) - n)[which] - (after - size)
        ids = flat[np.arange(after[-1]) + np.repeat(shift, size)]
        return np.split(ids, np.append(0, after)[np.searchsorted(starts, ends[:-1])])

    def encode_each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order. Texts are taken in groups of about STEP characters, whose new words are learnt together."""
        held: list[str] = []
        size = 0
        for text in texts:
            marked = self.marks is not None and any(s in text for s in self.added)
            if not marked and len(text) <= STEP:
                held.append(text)
                size += len(text)
                if size < STEP:
                    continue
            yield from self._together(held)
            held, size = [], 0
            if marked or len(text) > STEP:
                yield self._long(text, marked)
        yield from self._together(held)

    def _long(self, text: str, marked: bool) -> np.ndarray:
        """The ids of a text with special strings or of many characters."""
        if marked and not self.simple:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        out, last = [np.zeros(0, np.uint32)], 0
        for m in [*(self.marks.finditer(text) if marked else ()), None]:
            at, stop = last, m.start() if m else len(text)
            while at < stop:
                cut = _SAFE.search(text, at + STEP, stop) if stop - at > STEP else None
                end = cut.start() if cut else stop
                out += self._together([text[at:end]])
                at = end
            if m:
                out.append(np.array([self.added[m.group()]], np.uint32))
                last = m.end()
        return np.concatenate(out)

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids."""
        return next(self.encode_each([text]))


def encoder(path: str | None = None, special: bool = True) -> Encoder:
    """This worker's encoder of a file."""
    key = (path or vocabulary_path(), special)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def token_strings(path: str | None = None) -> list[str]:
    """The vocabulary's strings by id."""
    t = encoder(path).tokenizer
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
