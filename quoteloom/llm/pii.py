"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what these miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii_examples
from .common import documents
from .textkit import mix64, powers, prefix_sums, runs

#: Kinds in the order they are listed: those of the patterns, then those that only the model finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "address", "id", "birth")
#: Kinds that the model tags.
TAGGED = ("email", "phone", "name", "address", "id", "birth")
TAGS = ("O", *(f"{p}-{k}" for k in TAGGED for p in "BI"))
#: Labelled rows that a model is trained on, at most; those of the lowest hashes are taken.
ROWS = 4_000
#: Documents whose sentences become rows of words without personal data, and sentences of each, at most.
SAMPLE, SENTENCES = 300, 2
#: Words to either side whose features count, steps of the training, and its penalty on weights.
REACH, STEPS, PENALTY = 2, 120, 0.02
#: What beginning a span costs beside the learned weights: a doubtful span isn't one.
CAUTION = 2.0
#: Bytes of a block of texts.
BLOCK = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Classes of bytes: capitals X, other letters and all beyond ASCII x, digits 0, and each other byte itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = ord("0"), ord("X"), ord("x"), ord("x")
_LETTER = (_CLASS == ord("X")) | (_CLASS == ord("x"))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn test."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, each found from its @: what stands before can only be the run of local characters."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        while m and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the fixed patterns by kind, in code points. Matches that fail a test are dropped and not retried."""
    found = {k: [] for k in BASE}
    found["email"] = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 38:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# --- words, shapes and features

_CUE_KEY = {int.from_bytes(c.encode()[:8].ljust(8, b"\0"), "little"): c for c in dict.fromkeys(pii_examples.CUES)}
_CUE_KEYS = np.array(sorted(_CUE_KEY), np.uint64)


@dataclass
class Words:
    """Words of concatenated texts: byte bounds, the key of their type (shape and cue), and the ends of sentences (exclusive, in words)."""

    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    cues: np.ndarray
    stops: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts.

    The shape of a word has its classes of bytes with runs of capitals and of
    other letters shortened to one; digits stay. Its cue is its leading letters,
    if they are a word of CUES. A sentence ends with its line and after a word
    that ends in a full stop, exclamation or question mark, unless it is a cue.
    """
    starts, ends = runs(data, offsets, _WORD)
    n = len(starts)
    kind = _CLASS[data]
    again = np.zeros(len(data), bool)
    again[1:] = (kind[1:] == kind[:-1]) & _LETTER[data[1:]]
    again[starts] = False
    keep = _WORD[data] & ~again
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    sums = prefix_sums(kind[keep])
    a, b = place[starts], place[ends]
    shape = mix64((sums[b] - sums[a]) * powers(len(sums))[1][a] + (b - a).astype(np.uint64))
    padded = np.concatenate([data, np.full(9, 0x20, np.uint8)])
    nine = np.lib.stride_tricks.sliding_window_view(padded, 9)[starts] if n else np.zeros((0, 9), np.uint8)
    letters = _LETTER[nine]
    letters[np.arange(9)[None, :] >= (ends - starts)[:, None]] = False
    lead = np.where(letters.all(1), 9, letters.argmin(1))
    lower = np.frombuffer(np.ascontiguousarray(nine[:, :8]).tobytes().translate(_LOWER), np.uint64)
    bits = (np.uint64(8) * np.minimum(lead, 8).astype(np.uint64))
    mask = np.where(lead >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
    key = np.where(lead == 9, np.uint64(0), lower & mask)
    at = np.minimum(np.searchsorted(_CUE_KEYS, key), len(_CUE_KEYS) - 1)
    cues = np.where(_CUE_KEYS[at] == key, at + 1, 0)
    stop = _END[data[ends - 1]] & (cues == 0) if n else np.zeros(0, bool)
    line = np.concatenate([[0], np.cumsum(data == 10)])[starts] if n else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets[1:], starts, "right")
    if n:
        stop[:-1] |= (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        stop[-1] = True
    return Words(starts, ends, shape ^ mix64(cues.astype(np.uint64)), cues, np.flatnonzero(stop) + 1)


def features(word: str, cue: str) -> list[str]:
    """Names of the features of a word's type: all follow from its shape and its cue."""
    kinds = [("X" if "A" <= c <= "Z" else "x" if c.isascii() and c.isalpha() or not c.isascii() else "0" if c.isdigit() else c) for c in word]
    shape = "".join(k for i, k in enumerate(kinds) if not (i and k in "Xx" and kinds[i - 1] == k))
    bare = shape.strip(".,;:!?\"'")
    digits = bare.count("0")
    out = ["bias", f"shape {bare[:40]}", f"rough {re.sub('0+', '0', bare)[:20]}", f"digits {min(digits, 12)}", f"end {shape[-1:] if shape[-1:] in '.,;:!?)' else ''}"]
    out += [f"has {c}" for c in "@-/().+" if c in bare]
    out.append("letters" if not digits and set(bare) <= {"X", "x"} else "numeral" if digits and set(bare) <= set("0-/().+") else "mixed")
    if bare[:1] == "X":
        out.append("capital")
    if cue:
        out += [f"cue {cue}", "cue"]
        if shape.endswith(":"):
            out.append(f"cue {cue}:")
    return out


_EDGE = ["edge"]


# --- the model


@dataclass
class Model:
    """Weights (place, feature, tag) of a linear-chain CRF, its transitions and starts, and a table of the types that it has met."""

    names: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    caution: float = CAUTION

    def __post_init__(self):
        begins = np.array([t[0] == "B" for t in TAGS])
        self.from_, self.first = self.steps - self.caution * begins[None], self.start - self.caution * begins
        self.keys, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tables = self._row(_EDGE)[:, None, :]
        self._bound()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("names", "weights", "steps", "start", "caution")}

    def __setstate__(self, state):
        self.__init__(**state)

    def _row(self, feats: list[str]) -> np.ndarray:
        at = [self.names[f] for f in feats if f in self.names]
        return self.weights[:, at].sum(1)

    def _bound(self) -> None:
        self.margins = (self.tables[:, :, 1:] - self.tables[:, :, :1]).max(2)
        t, o = self.from_, self.from_[0, 0]
        self.within = float((t[1:, 1:] - o).max())
        enter = max(float((t[0, 1:] - o).max()), float((self.first[1:] - self.first[0]).max()))
        self.around = enter + max(0.0, float((t[1:, 0] - o).max()))

    def types(self, data: np.ndarray, words: Words) -> np.ndarray:
        """Places of the words' types in the tables; new types get a row (place 0 is what lies beyond a sentence)."""
        at = np.minimum(np.searchsorted(self.keys, words.keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != words.keys if len(self.keys) else np.ones(len(words.keys), bool)
        if new.any():
            keys, first = np.unique(words.keys[new], return_index=True)
            first = np.flatnonzero(new)[first]
            rows = [self._row(features(data[words.starts[i] : words.ends[i]].tobytes().decode("utf-8", "replace"), _CUE_KEY[int(_CUE_KEYS[words.cues[i] - 1])] if words.cues[i] else "")) for i in first.tolist()]
            index = np.arange(len(keys)) + self.tables.shape[1]
            self.tables = np.concatenate([self.tables, np.stack(rows, 1)], 1)
            by = np.argsort(every := np.concatenate([self.keys, keys]))
            self.keys, self.index = every[by], np.concatenate([self.index, index])[by]
            self._bound()
            at = np.searchsorted(self.keys, words.keys)
        return self.index[at]

    def _open(self, gain: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """Which words can be other than O on a best path, given the most that each can gain over O.

        A stretch of such words gains at most its words' gains, ``around`` for its
        ends and ``within`` for each step inside; where it can't pay, O is better. So
        a word counts only if the best stretch that holds it can pay.
        """
        u = np.maximum(gain + self.within, -100.0)
        sums, far = np.cumsum(u), 1e5 * sentence
        left = sums - far - np.minimum.accumulate(sums - u - far)
        back = np.cumsum(u[::-1])
        far = 1e5 * (sentence[-1] - sentence[::-1])
        right = (back - far - np.minimum.accumulate(back - u[::-1] - far))[::-1]
        return left + right - u >= self.within - self.around - 1e-6

    def tag(self, data: np.ndarray, words: Words) -> np.ndarray:
        """The tag of each word: Viterbi over each sentence, run only over the stretches that can be other than O."""
        n = len(words.starts)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        kind = self.types(data, words)
        sentence = np.repeat(np.arange(len(words.stops)), np.diff(words.stops, prepend=0))
        near = []
        for k in range(-REACH, REACH + 1):
            other = np.zeros(n, np.int64)
            if k < 0:
                other[-k:] = np.where(sentence[-k:] == sentence[:k], kind[:k], 0)
            elif k:
                other[:-k] = np.where(sentence[:-k] == sentence[k:], kind[k:], 0)
            near.append(kind if not k else other)
        gain = sum(self.margins[k][at] for k, at in enumerate(near))
        maybe = np.flatnonzero(self._open(gain, sentence))
        emit = sum(self.tables[k][at[maybe]] for k, at in enumerate(near))
        gain[:] = -100.0
        gain[maybe] = (emit[:, 1:] - emit[:, :1]).max(1)
        open_ = self._open(gain, sentence)[maybe]
        at, emit = maybe[open_], emit[open_]
        if not len(at):
            return out
        new = np.flatnonzero((np.diff(at, prepend=-9) > 1) | (np.diff(sentence[at], prepend=-1) > 0))
        size = np.diff(new, append=len(at))
        order = np.argsort(-size, kind="stable")
        new, size = new[order], size[order]
        ends = np.zeros(n, bool)
        ends[words.stops - 1] = True
        opens, closes = at[new] == (words.stops - np.diff(words.stops, prepend=0))[sentence[at[new]]], ends[at[new + size - 1]]
        tags = np.zeros(len(at), np.int8)
        for low in range(0, len(new), 4096):
            part = slice(low, low + 4096)
            self._viterbi(emit, new[part], size[part], opens[part], closes[part], tags)
        out[at] = tags
        return out

    def _viterbi(self, emit: np.ndarray, first: np.ndarray, size: np.ndarray, opens: np.ndarray, closes: np.ndarray, out: np.ndarray) -> None:
        """Best paths of stretches of falling size, all at once, a word a step; one that doesn't open or close its sentence has O beside it."""
        score, back = np.where(opens[:, None], self.first, self.from_[0]) + emit[first], []
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, "left"))  # those of more than t words
            through = score[:live, :, None] + self.from_[None]
            best = through.argmax(1)
            back.append(best.astype(np.int8))
            score[:live] = through.max(1) + emit[first[:live] + t]
        tag = (score + np.where(closes[:, None], 0.0, self.from_[:, 0])).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            out[first[:live] + t] = tag[:live]
            if t:
                tag[:live] = back[t - 1][np.arange(live), tag[:live]]


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Which tag may follow which, and which may begin: I-k only after B-k or I-k."""
    inside = np.array([t[0] == "I" for t in TAGS])
    same = np.array([[t[2:] == u[2:] and u != "O" for t in TAGS] for u in TAGS])
    return ~inside[None] | same, ~inside


def _encode(rows: list[tuple[list[str], list[str]]]) -> tuple[dict[str, int], list[np.ndarray], np.ndarray, np.ndarray]:
    names, types, type_rows, seqs = {}, {}, [], []
    for words, _ in rows:
        raw = " ".join(words).encode()
        w = split_words(data := np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        seq = []
        for i in range(len(w.starts)):
            word, cue = data[w.starts[i] : w.ends[i]].tobytes().decode(), _CUE_KEY[int(_CUE_KEYS[w.cues[i] - 1])] if w.cues[i] else ""
            feats = tuple(features(word, cue))
            if feats not in types:
                types[feats] = len(types) + 1
                type_rows.append([names.setdefault(f, len(names)) for f in feats])
            seq.append(types[feats])
        seqs.append(np.array(seq))
    edge = names.setdefault(_EDGE[0], len(names))
    table = np.zeros((len(types) + 1, len(names)))
    table[0, edge] = 1
    for i, at in enumerate(type_rows):
        table[i + 1, at] = 1
    size = np.array([len(s) for s in seqs])
    return names, seqs, table, size


def fit(rows: list[tuple[list[str], list[str]]], steps: int = STEPS, penalty: float = PENALTY, caution: float = CAUTION) -> Model:
    """A CRF of the largest penalised likelihood of labelled rows (words, tags), by full-batch steps with moments (Adam); deterministic."""
    may, may_start = allowed()
    count = len(TAGS)
    rows = sorted((r for r in rows if r[0]), key=lambda r: -len(r[0]))
    if not rows:
        return Model({}, np.zeros((2 * REACH + 1, 0, count)), np.where(may, 0.0, -1e4), np.where(may_start, 0.0, -1e4) - 10.0 * (np.arange(count) > 0), caution)
    names, seqs, table, size = _encode(rows)
    n, longest, places = len(seqs), int(size[0]), 2 * REACH + 1
    real = np.arange(longest)[None] < size[:, None]
    beside = np.zeros((n, longest + 2 * REACH), np.int64)
    gold = np.zeros((n, longest), np.int64)
    for i, (s, (_, tags)) in enumerate(zip(seqs, rows, strict=True)):
        beside[i, REACH : REACH + len(s)] = s
        gold[i, : len(s)] = [TAGS.index(t) for t in tags]
    kinds = [beside[:, p : p + longest][real] for p in range(places)]
    orders = [np.argsort(k, kind="stable") for k in kinds]
    firsts = [np.flatnonzero(np.diff(k[o], prepend=-1)) for k, o in zip(kinds, orders, strict=True)]
    live = [int((size > t).sum()) for t in range(longest)]
    params = [np.zeros((places, len(names), count)), np.zeros((count, count)), np.zeros(count)]
    weights, steps_w, start_w = params
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    want_steps = np.zeros((count, count))
    np.add.at(want_steps, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    want_start = np.bincount(gold[:, 0], minlength=count).astype(float)
    onehot = np.eye(count)[gold[real]]
    for step in range(1, steps + 1):
        scores = sum((table @ weights[p])[kinds[p]] for p in range(places))
        emit = np.ones((n, longest, count))
        emit[real] = np.exp(scores - scores.max(1, keepdims=True))
        a = np.exp(steps_w) * may
        alpha, norm, beta = np.zeros((n, longest, count)), np.ones((n, longest, 1)), np.ones((n, longest, count))
        at = np.exp(start_w) * may_start * emit[:, 0]
        for t in range(longest):
            m = live[t]
            if t:
                at = alpha[:m, t - 1] @ a * emit[:m, t]
            norm[:m, t] = at.sum(1, keepdims=True)
            alpha[:m, t] = at / norm[:m, t]
        for t in range(longest - 2, -1, -1):
            m = live[t + 1]
            beta[:m, t] = (emit[:m, t + 1] * beta[:m, t + 1] / norm[:m, t + 1]) @ a.T
        gamma = (alpha * beta)[real]
        later = real[:, 1:]
        pair = alpha[:, :-1][later].T @ (emit * beta / norm)[:, 1:][later] * a
        off = onehot - gamma
        own = np.zeros((places, len(table), count))
        for p in range(places):
            own[p][kinds[p][orders[p]][firsts[p]]] = np.add.reduceat(off[orders[p]], firsts[p])
        grads = [table.T @ own - penalty * weights, want_steps - pair - penalty * steps_w, want_start - (alpha * beta)[:, 0].sum(0) - penalty * start_w]
        for w, g, m, v in zip(params, grads, moment, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.2 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(names, weights, np.where(may, steps_w, -1e4), np.where(may_start, start_w, -1e4), caution)


# --- the labelled table


def parse_line(line: str) -> tuple[list[str], list[str]]:
    """(words, tags) of a line whose personal parts are marked as ``[kind words]``."""
    words, tags, at = [], [], 0
    for m in re.finditer(rf"\[({'|'.join(TAGGED)}) ((?:[^\[\]]|\[[^\]]*\])*)\]", line):
        plain = line[at : m.start()].split()
        inner = m[2].split()
        after = re.match(r"\S*", line[m.end() :])[0]
        inner[-1] += after
        words += plain + inner
        tags += ["O"] * len(plain) + [f"{'I' if i else 'B'}-{m[1]}" for i in range(len(inner))]
        at = m.end() + len(after)
    rest = line[at:].split()
    return words + rest, tags + ["O"] * len(rest)


def tagged(text: str) -> list[tuple[list[str], list[str]]]:
    """The sentences of a text with the tags that the patterns give; ips and cards are O, as their patterns are whole."""
    spans = base_spans(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    w = split_words(raw, np.array([0, len(raw)]))
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    a, b = place[w.starts], place[w.ends]
    tags = np.full(len(a), "O", object)
    for kind in ("email", "phone"):
        for s, e in spans[kind]:
            hit = np.flatnonzero((a < e) & (b > s))
            tags[hit] = f"I-{kind}"
            tags[hit[:1]] = f"B-{kind}"
    words = [raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
    cuts = [0, *w.stops.tolist()]
    return [(words[i:j], tags[i:j].tolist()) for i, j in zip(cuts, cuts[1:], strict=False)]


def labelled_table(docs: DataFrame, lines: str = pii_examples.LINES, sample: int = SAMPLE, sentences: int = SENTENCES) -> DataFrame:
    """(words array, tags array): the marked lines, and sentences of at most ``sample`` documents with the patterns' tags.

    Of each document of the lowest hashes, sentences of 5 to 24 words are taken
    as their hashes order them: what the model sees of the corpus's own words.
    Each marked line is also set amid such a sentence.
    """
    def run(batches):
        for b in batches:
            for text in b.column("text").to_pylist():
                rows = [r for r in tagged(text) if 5 <= len(r[0]) <= 24]
                rows.sort(key=lambda r: hashlib.md5(" ".join(r[0]).encode("utf-8", "surrogatepass")).digest())
                rows = rows[:sentences]
                yield pa.RecordBatch.from_pydict({"words": pa.array([r[0] for r in rows], pa.list_(pa.string())), "tags": pa.array([r[1] for r in rows], pa.list_(pa.string()))})

    own = docs.where("text IS NOT NULL").select("text", F.xxhash64("doc_id", "text").alias("h"))
    own = own.join(F.broadcast(own.select("h").orderBy("h").limit(sample).distinct()), "h").select("text")
    found = own.mapInArrow(run, "words array<string>, tags array<string>")
    context = sorted((list(r["words"]), list(r["tags"])) for r in found.collect())  # sample * sentences rows of at most 24 words
    rows = [parse_line(x) for x in lines.strip().splitlines()]
    plain = [c for c in context if set(c[1]) == {"O"}]
    amid = []
    for i, (w, t) in enumerate(rows):
        if plain:
            cw, ct = plain[i * 7 % len(plain)]
            cut = len(cw) // 2
            amid.append((cw[:cut] + w + cw[cut:], ct[:cut] + t + ct[cut:]))
    return docs.sparkSession.createDataFrame(rows + amid + context, "words array<string>, tags array<string>")


def train(labelled: DataFrame, rows: int = ROWS) -> Model:
    """A model of a small labelled table (words array, tags array): at most ``rows`` of its rows, those of the lowest hashes."""
    few = labelled.where("size(words) > 0 AND size(words) = size(tags)").orderBy(F.xxhash64("words", "tags")).limit(rows).collect()
    return fit(sorted((list(r["words"]), list(r["tags"])) for r in few))


# --- finding


def _trim(word: str, start: int, end: int) -> tuple[int, int]:
    """A span without the marks around it; a parenthesis stays if its partner is inside."""
    while start < end:
        part = word[start:end]
        if part[-1] in ".,;:!?\"'>]}" and not (part[-1] in "]}" and {"]": "[", "}": "{"}[part[-1]] in part) or part[-1] == ")" and "(" not in part:
            end -= 1
        elif part[0] in "\"'<,;:" or part[0] == "(" and ")" not in part:
            start += 1
        else:
            break
    return start, end


def _blocks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, byte where the block begins in it, bytes, offsets): texts together, or blocks of a long one that end with a line if there is one, else with a word."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BLOCK:
            yield first, 0, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            held, size = [], 0
        if len(raw) > 2 * BLOCK:
            at = 0
            while at < len(raw):
                to = at + BLOCK
                if to < len(raw):
                    line = raw.rfind(b"\n", at, to)
                    space = re.compile(rb"[\x20\x09-\x0D]").search(raw, to) if line < 0 else None
                    to = line + 1 if line >= 0 else space.end() if space else len(raw)
                part = np.frombuffer(raw[at:to], np.uint8)
                yield i, at, part, np.array([0, len(part)])
                at = to
            continue
        if not held:
            first = i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, 0, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


def model_spans(texts: list[str], model: Model) -> dict[int, list[tuple[str, int, int]]]:
    """(kind, start, end) in code points that the model finds, by the text's place."""
    out: dict[int, list[tuple[str, int, int]]] = {}
    for first, at, data, offsets in _blocks(texts):
        w = split_words(data, offsets)
        tags = model.tag(data, w)
        begins = np.flatnonzero(tags % 2 == 1)  # B tags have odd places
        if not len(begins):
            continue
        rest = np.flatnonzero(~((tags > 0) & (tags % 2 == 0)))
        ends = np.append(rest, len(tags))[np.searchsorted(rest, begins, "right")]
        doc = np.searchsorted(offsets, w.starts[begins], "right") - 1
        for d in np.unique(doc).tolist():
            raw, base = data[offsets[d] : offsets[d + 1]], int(offsets[d])
            place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            ahead = len(texts[first].encode("utf-8", "surrogatepass")[:at].decode("utf-8", "surrogatepass")) if at else 0
            text = texts[first + d]
            for b, e in zip(begins[doc == d].tolist(), ends[doc == d].tolist(), strict=True):
                s, t = _trim(text, ahead + int(place[w.starts[b] - base]), ahead + int(place[w.ends[e - 1] - base]))
                if s < t:
                    out.setdefault(first + d, []).append((TAGGED[(int(tags[b]) - 1) // 2], s, t))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model of each row of docs (doc_id, text).

    Base spans are those of the fixed patterns. The model's spans that overlap no
    base span are added, under the kinds of KINDS; n_model counts them. Null texts
    are empty, texts are read whole, repeated rows are rows of their own, a null
    doc_id stays, an empty table gives an empty result, and of tags of equal scores the
    first in TAGS counts. Types of words are told apart by a 64-bit hash. Other
    columns aren't read.
    """
    counts = [f"n_{k}" for k in BASE]

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                texts = part.column("text").to_pylist()
                more = model_spans(texts, model)
                rows = []
                for i, text in enumerate(texts):
                    base = base_spans(text)
                    spans = [(k, s, e) for k in BASE for s, e in base[k]]
                    own = _joined(spans)
                    added = [x for x in more.get(i, ()) if not any(s < x[2] and x[1] < e for _, s, e in spans)] if len(spans) < 100 else _free(more.get(i, []), spans)
                    rows.append([*(len(base[k]) for k in BASE), hashlib.sha256(own.encode()).hexdigest(), _joined(spans + added) if added else own, len(added)])
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())], ["doc_id", *counts, "base_sha256", "spans", "n_model"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string, n_model long")


def _free(added: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The added spans that overlap no other, where there are many."""
    starts = np.array(sorted((s, e) for _, s, e in spans)).reshape(-1, 2)
    reach = np.maximum.accumulate(starts[:, 1])
    before = [int(np.searchsorted(starts[:, 0], x[2])) for x in added]
    return [x for x, k in zip(added, before, strict=True) if not k or reach[k - 1] <= x[1]]


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents, by a model of the labelled lines and of sentences of a bounded sample."""
    docs = documents(spark, sf_dir)
    return find(docs, train(labelled_table(docs)))
