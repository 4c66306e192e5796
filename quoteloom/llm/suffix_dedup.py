"""Removal of repeated substrings by column-wise suffix sorting of a document collection."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .textkit import _TABLE, mix64, powers

#: Bytes that a removed string has at least.
LENGTH = 200
#: Bytes of an anchor. Each string of LENGTH bytes has one: its k-gram of the lowest hash, the last of equal ones.
ANCHOR = 32
#: Occurrences of an anchor that one sort takes, about; those of a more frequent one are dealt to several.
GROUP = 1_000
#: Rows that are sorted together.
ROWS = 2_048
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20


def anchors(raw: bytes, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first and last start of the strings that it is the anchor of), by position.

    Equal strings have equal anchors at equal places, wherever they are.
    """
    w = length - k + 1
    out: list[list[np.ndarray]] = [[], [], [], []]
    total = len(raw) - length + 1  # strings
    for at in range(0, max(0, total), BLOCK):
        data = np.frombuffer(raw[at : at + BLOCK + length - 1], np.uint8)
        n = len(data) - k + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(len(data))[0], out=sums[1:])
        h = mix64((sums[k:] - sums[:-k]) * powers(len(data))[1][:n])
        # the low 21 bits give the place, so that minima are unique and the last of equals wins
        key = (h & ~np.uint64((1 << 21) - 1)) | (np.uint64((1 << 21) - 1) - np.arange(n, dtype=np.uint64))
        low, width = key, 1
        while width * 2 <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < w:
            low = np.minimum(low[: n - w + 1], low[w - width : w - width + n - w + 1])
        place = (np.uint64((1 << 21) - 1) - (low & np.uint64((1 << 21) - 1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        for k_, v in enumerate((h[p].view(np.int64), p + at, first + at, last + at)):
            out[k_].append(v)
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)


def repeated(columns: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For aligned byte strings: [row, column] is True where the ``length`` bytes from there occur in another row of the group.

    ``columns`` holds a symbol a cell, 256 where a string has none; ``group``
    rises. Each round inserts one symbol of each string, from the last column to
    the first. What is kept between rounds is the Burrows-Wheeler transform of
    the column, that is in the order of the strings' suffixes the symbol before
    each, and ``common``, the length of the prefix that each suffix shares with
    the one before it. A round reads both in sequence: a symbol's rank among its
    equals is where its suffix goes (a stable sort), and what two neighbours with
    the same symbol share is one more than the least that lay between them.
    """
    m, width = columns.shape
    out = np.zeros((m, width), bool)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)
    base = group.astype(np.int64) * 257
    transform = columns[:, width - 1]
    for c in range(width - 1, -1, -1):
        key = base[order] + transform
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = np.flatnonzero((key[1:] == key[:-1]) & (transform[by[1:]] < 256)) + 1
        new = np.zeros(m + 1, np.int32)
        if len(same):
            pairs = np.empty(2 * len(same), np.int64)
            pairs[0::2] = by[same - 1] + 1
            pairs[1::2] = by[same] + 1
            new[same] = np.minimum.reduceat(common, pairs)[0::2] + 1
        order, common = order[by], new
        transform = columns[order, c - 1]
        hit = common[:m] >= length
        out[order[hit], c] = True
        out[order[np.flatnonzero(hit) - 1], c] = True
    return out


#: Bits that a text's place takes; above them a further part of its identity travels.
_PLACE = 40


def _identity(doc_id, text: str) -> tuple[int, int]:
    """64 and 15 bits that any reading of a row gives it: texts are joined by the first and told apart by the second."""
    h = xxhash.xxh3_128_intdigest(f"{doc_id}\n".encode() + text.encode("utf-8", "surrogatepass"))
    low = h & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low, h >> 113


def _rows(b: pa.RecordBatch):
    for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
        yield i, t.as_py() or ""


def _anchors(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            hs, ids, packed = [], [], []
            for i, text in _rows(b.slice(at, 256)):
                h, p, s1, s2 = anchors(text.encode("utf-8", "surrogatepass"))
                hs.append(h)
                did, tag = _identity(i, text)
                ids.append(np.full(len(h), did))
                packed.append(tag << 47 | p << 16 | (p - s1) << 8 | (p - s2))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (hs, ids, packed)], ["h", "did", "place"])


def _pieces(batches, n: int = 256):
    """Batches of a few rows: what is unpacked from them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def _packed(batches):
    z = zstandard.ZstdCompressor(level=3)
    for b in _pieces(batches):
        rows = list(_rows(b))
        own = [_identity(i, t) for i, t in rows]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.int64()), pa.array([g for _, g in own], pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for _, t in rows], pa.binary())], ["did", "tag", "doc_id", "z"])


def _cut(batches):
    """Documents with their repeated anchors -> the strings around each anchor."""
    z = zstandard.ZstdDecompressor()
    names = ["h", "part", "did", "at", "lead", "bytes"]
    for b in _pieces(batches):
        rows: list[tuple] = []
        for did, tag, raw, found in zip(b.column("did").to_pylist(), b.column("tag").to_pylist(), b.column("z").to_pylist(), b.column("found").to_pylist(), strict=True):
            raw = z.decompress(raw)
            for f in found:
                if f["place"] >> 47 != tag:
                    continue
                p, lead, tail = f["place"] >> 16 & 0x7FFFFFFF, f["place"] >> 8 & 255, f["place"] & 255
                rows.append((f["h"], (did + p) % f["parts"] if f["parts"] else -1, did, tag << _PLACE | p - lead, lead, raw[p - lead : p - tail + LENGTH]))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CUT, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CUT, strict=True)], names)


_CUT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _search(batches):
    """Sorted strings -> rows of spans (did, start, end), and of strings that another part of their anchor may have (h, digest)."""

    def solve(rows: list[tuple]):
        # equal strings of a group are one row of the sort
        rows.sort(key=lambda r: (r[0], r[1]))
        index: dict[tuple, int] = {}
        owners: list[list[tuple]] = []
        for r in rows:
            k = index.setdefault((r[0], r[1], r[4], r[5]), len(owners))
            if k == len(owners):
                owners.append([])
            owners[k].append((r[2], r[3]))
        keys = list(index)
        lead = np.array([k[2] for k in keys])
        size = np.array([len(k[3]) for k in keys])
        left = int(lead.max())
        width = left + int((size - lead).max())
        columns = np.full((len(keys), width), 256, np.int16)
        for i, k in enumerate(keys):
            columns[i, left - k[2] : left - k[2] + len(k[3])] = np.frombuffer(k[3], np.uint8)
        group = np.cumsum([0, *[a[:2] != b[:2] for a, b in zip(keys[1:], keys[:-1], strict=True)]])
        hits = repeated(columns, group)
        for i, k in enumerate(keys):
            from_ = left - k[2]
            n = len(k[3]) - LENGTH + 1
            own = np.ones(n, bool) if len(owners[i]) > 1 else hits[i, from_ : from_ + n]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                for did, at in owners[i]:
                    yield did, at + a, at + e - 1 + LENGTH, None, None
            if k[1] >= 0:  # one of several parts
                did, at = owners[i][0]
                for s in range(n):
                    digest = xxhash.xxh3_128_digest(k[3][s : s + LENGTH])
                    if own[s]:
                        yield None, None, None, s - k[2], digest
                    else:
                        yield did, at + s, at + s + LENGTH, s - k[2], digest

    def emit(rows):
        got = list(solve(rows))
        h = rows[0][0]
        cols = list(zip(*got, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array([h if d is not None else None for d in cols[4]], pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], ["h", "did", "start", "end", "offset", "digest"])

    held: list[tuple] = []
    for b in _pieces(batches, 1024):
        for r in zip(*(b.column(n).to_pylist() for n in ("h", "part", "did", "at", "lead", "bytes")), strict=True):
            if held and r[:2] != held[-1][:2] and (len(held) >= ROWS or r[1] >= 0 or held[-1][1] >= 0):
                yield emit(held)
                held = []
            held.append(r)
    if held:
        yield emit(held)


def _remove(batches):
    z = zstandard.ZstdDecompressor()
    for b in _pieces(batches):
        rows = []
        for doc_id, tag, raw, spans in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = z.decompress(raw)
            merged: list[list[int]] = []
            base = tag << _PLACE
            for s in sorted((s["start"] - base, s["end"] - base) for s in spans or () if s["start"] >> _PLACE == tag):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, last = hashlib.sha256(), 0
            for a, e in merged:
                kept.update(raw[last:a])
                last = e
            kept.update(raw[last:])
            rows.append((doc_id, len(raw), sum(e - a for a, e in merged), len(merged), kept.hexdigest(), ",".join(f"{a}:{e}" for a, e in merged)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of each row of docs (doc_id, text).

    Each byte is removed that a string of LENGTH bytes covers which also starts
    anywhere else, in the same text or another; null texts are empty, texts
    shorter than LENGTH lose nothing, and of repeated rows each is removed
    whole. Other columns aren't read; an empty table gives an empty result.

    Equal strings have the same anchor, so only the surroundings of anchors that
    occur twice are cut out; they are sorted column by column in groups of an
    anchor (see repeated()). An anchor of more than GROUP occurrences, be it in
    many texts or in one that repeats itself, is dealt to several groups by text
    and place. They leave the strings that they don't find twice, and one of
    each that they do, to be counted over all groups by 128-bit hash. Spark's
    sorted shuffle files are the external files that a group is read from in
    sequence. A task holds ROWS surroundings, one group at least, and one text
    with the places of its anchors.
    """
    rows = docs.select("doc_id", "text")
    found = rows.mapInArrow(_anchors, "h long, did long, place long")
    # stored, so that both sides of the join are dealt anew and Spark can split a frequent anchor
    twice = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.when(F.col("n") > GROUP, F.ceil(F.col("n") / GROUP)).otherwise(0)
    places = found.join(twice, "h").groupBy("did").agg(F.collect_set(F.struct("place", "h", parts.cast("long").alias("parts"))).alias("found"))
    texts = rows.mapInArrow(_packed, "did long, tag long, doc_id long, z binary")
    cut = texts.join(places, "did").select("did", "tag", "z", "found").mapInArrow(_cut, "h long, part long, did long, at long, lead int, bytes binary")
    hits = stored(cut.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_search, "h long, did long, start long, end long, offset int, digest binary"))
    open_ = hits.where("digest IS NOT NULL")
    again = open_.groupBy("h", "offset", "digest").count().where("count > 1").drop("count")
    late = open_.where("did IS NOT NULL").join(again, ["h", "offset", "digest"], "left_semi")
    spans = hits.where("digest IS NULL").select("did", "start", "end").unionByName(late.select("did", "start", "end"))
    spans = spans.groupBy("did").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return texts.join(spans, "did", "left").select("doc_id", "tag", "z", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents."""
    return dedup(documents(spark, sf_dir))
