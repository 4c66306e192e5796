"""NumPy kernels on UTF-8 bytes that several operators of this folder share.

All kernels read a text in blocks of ``BLOCK`` bytes that end at white space,
so the working memory follows the block and not the length of the text (only
the eight bytes a word of the results do).
"""

from __future__ import annotations

import numpy as np

#: Bytes a kernel holds in wide integers at once.
BLOCK = 1 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of uint64 values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of table[byte] * base**i, with a leading 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=out[1:])
    return out


def _blocks(raw: bytes):
    """Cuts bytes at white space, about every BLOCK bytes."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        if end < len(raw):
            data = np.frombuffer(raw, np.uint8, offset=end)
            step = BLOCK
            seen = 0
            while seen < len(data) and not _SPACE[data[seen : seen + step]].any():
                seen += step
            if seen < len(data):
                seen += int(_SPACE[data[seen : seen + step]].argmax())
            end += min(seen, len(data))
        yield raw[at:end]
        at = end


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes in concatenated texts; none crosses an offset."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    opens[cuts] = inside[cuts + 1]
    closes[cuts] = inside[cuts]
    return np.flatnonzero(opens), np.flatnonzero(closes)


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, in order."""
    if lower:
        raw = raw.translate(_LOWER)
    out = []
    for block in _blocks(raw):
        data = np.frombuffer(block, np.uint8)
        starts, ends = word_bounds(data)
        if len(starts):
            sums = prefix_sums(data)
            out.append(mix64((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mix64(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    A text of fewer words than the width has one shingle, its whole sequence;
    a text without words has none.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"), lower=True)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(width, len(words))) + np.uint64(min(width, len(words))))
