"""Ranked lexical search: a dual-sorted wavelet tree a shard, intersected node by node, best bound first."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, release, stored
from .textkit import mix64, powers, runs

#: A shard is closed when its texts have so many bytes. A longer text is a shard of its own.
SHARD_BYTES = 6 << 20
#: Results an item.
TOP = 20
#: Nodes of an item that are opened in a round, the best bounds first, and items of a round.
WIDTH, TOGETHER = 24, 50
#: Items in a pass over the shards. More items take more passes.
ITEMS = 2_000
#: Bytes hashed at once.
BLOCK = 1 << 20

_NONE = np.iinfo(np.int64).max  # stands for a null doc_id, which comes after all others
_IN = np.zeros(256, bool)
_IN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
SHARD = "n_docs int, seed int, doc_ids binary, hashes binary, ends binary, words binary, word_ends binary, impacts binary, bits binary"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of concatenated texts."""
    return runs(data, offsets, _IN)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each term of lower-case bytes, a block at a time."""
    out, table, at = np.empty(len(starts), np.uint64), _table(seed), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        base, n = starts[at], ends[to - 1] - starts[at]
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[base : base + n]] * up[:n], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def _same(data: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether each term of a has the bytes of the term of b in the same place; data has 8 bytes behind the last term."""
    n = a[1] - a[0]
    if (n != b[1] - b[0]).any():
        return False
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    for k in range(0, 64, 8):
        some = n > k
        if not some.any():
            return True
        x, y = (np.ascontiguousarray(eight[v[0][some] + k]).view(np.uint64).ravel() for v in (a, b))
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(n[some] - k, 8).astype(np.uint64))
        if ((x ^ y) << unused).any():  # little-endian: the first byte is the lowest
            return False
    long = np.flatnonzero(n > 64)
    return all(np.array_equal(data[a[0][i] : a[1][i]], data[b[0][i] : b[1][i]]) for i in long)


def _ragged(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of chosen rows of a ragged array, and the ends of these rows in the choice."""
    starts = np.concatenate([[0], ends[:-1]])[rows]
    n = ends[rows] - starts
    to = np.cumsum(n)
    return np.repeat(starts - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0), to


def build_shard(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """The index of some texts (ids, concatenated bytes and their offsets), given N and L of the corpus.

    Each term's postings are in order of falling impact, (1000000000 * tf) div
    (1000 * tf + 12 * m), and of doc_id where that ties; the sequence of their documents, numbered
    by doc_id, is a wavelet matrix. Equal hashes of different terms make the
    shard take another seed, so its terms are told apart by their bytes.
    """
    order = np.argsort(ids, kind="stable")
    to = np.cumsum(np.diff(offsets)[order])
    data = np.concatenate([*(_LOWER[data[offsets[i] : offsets[i + 1]]] for i in order.tolist()), np.zeros(8, np.uint8)])
    starts, ends = terms(data[:-8], np.concatenate([[0], to]))
    doc = np.searchsorted(to, starts, "right")
    n = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    m = 75 + (25 * n * n_docs) // max(n_terms, 1)
    seed = 0
    while True:
        h = hashes(data, starts, ends, seed)
        by = np.argsort(h)
        h = h[by]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        old = np.flatnonzero(~new)
        if _same(data, (starts[by[old]], ends[by[old]]), (starts[by[old - 1]], ends[by[old - 1]])):
            break
        seed += 1
    term = np.cumsum(new) - 1
    size = len(ids)
    key, tf = np.unique(term * size + doc[by], return_counts=True)
    term, doc = key // size, key % size
    tf = tf.astype(np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
    by_impact = np.lexsort((doc, -impact, term)) if len(term) and (int(term[-1]) + 1) * size >= 1 << 42 else np.argsort((term << 20 | ((1 << 20) - 1 - impact)) * size + doc)
    word = by[new]
    size_of = ends[word] - starts[word]
    word_ends = np.cumsum(size_of)
    at = np.repeat(starts[word] - (word_ends - size_of), size_of) + np.arange(int(size_of.sum()))
    seq, bits = doc[by_impact], []
    depth = max(1, (size - 1).bit_length())
    for level in range(depth):
        one = (seq >> (depth - 1 - level)) & 1 == 1
        bits.append(np.packbits(one, bitorder="little"))
        seq = np.concatenate([seq[~one], seq[one]])
    out = {"doc_ids": ids[order].astype(np.int64), "hashes": h[new], "ends": np.cumsum(np.bincount(term, minlength=len(word))).astype(np.int64), "words": data[at], "word_ends": word_ends.astype(np.int64), "impacts": impact[by_impact].astype(np.uint32), "bits": np.concatenate(bits)}
    return {"n_docs": size, "seed": seed} | {k: v.tobytes() for k, v in out.items()}


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (the largest long for null), concatenated UTF-8 bytes and offsets of a batch (doc_id, text without nulls)."""
    ids, text = batch.column(0).cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False), batch.column(1)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, ends, raw = text.buffers()
    offsets = np.frombuffer(ends, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return ids, data, offsets - offsets[0]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: its documents with a term, and its terms with repeats."""
    for b in batches:
        _, data, offsets = _texts(b)
        held, n, at = 0, 0, 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 4 * BLOCK, "right")) - 1)
            starts, _ = terms(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            doc = np.searchsorted(offsets[at + 1 : to + 1] - offsets[at], starts, "right")
            held, n, at = held + int((np.diff(doc) > 0).sum()) + bool(len(doc)), n + len(starts), to
        yield pa.RecordBatch.from_pydict({"docs": [held], "terms": [n]}, pa.schema({"docs": pa.int64(), "terms": pa.int64()}))


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """(stored shards, N, L) of docs (doc_id, text): the documents with a term, and all their terms.

    A task makes its own partitions into shards, so nothing is shuffled and a
    task holds one shard and one batch. Null texts are empty, and documents
    without a term are in no shard's lists. Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (int(v or 0) for v in total)

    def run(batches):
        held: list[tuple] = []

        def flush():
            sizes = np.concatenate([np.diff(o) for _, _, o in held])
            row = build_shard(np.concatenate([i for i, _, _ in held]), np.concatenate([d for _, d, _ in held]), np.concatenate([[0], np.cumsum(sizes)]), n_docs, n_terms)
            held.clear()
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, pa.schema({k: pa.int32() if k in ("n_docs", "seed") else pa.binary() for k in row}))

        for b in batches:
            ids, data, offsets = _texts(b)
            at = 0
            while at < len(ids):
                room = shard_bytes - sum(len(d) for _, d, _ in held)
                to = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
                if to <= at and held:
                    yield flush()
                    continue
                to = max(at + 1, to)
                held.append((ids[at:to].copy(), data[offsets[at] : offsets[to]].copy(), offsets[at : to + 1] - offsets[at]))
                at = to
        if held:
            yield flush()

    return stored(rows.mapInArrow(run, SHARD)), n_docs, n_terms


class Shard:
    """A shard read back; its tree is laid out only when a list is searched."""

    def __init__(self, row: dict):
        view = lambda k, t: np.frombuffer(row[k], t)
        self.size, self.seed = row["n_docs"], row["seed"]
        self.hashes, self.ends, self.word_ends = view("hashes", np.uint64), view("ends", np.int64), view("word_ends", np.int64)
        self.words = row["words"]
        self.depth = max(1, (self.size - 1).bit_length())
        if "bits" in row:
            self.doc_ids, self.impacts, self._bits = view("doc_ids", np.int64), view("impacts", np.uint32), view("bits", np.uint8)

    def lists(self, hashed: np.ndarray, asked: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each asked term's list; 0, 0 for terms that aren't here."""
        low, high = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        at = np.searchsorted(self.hashes, hashed)
        for i in np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashed) if len(self.hashes) else ():
            k = at[i]
            if self.words[self.word_ends[k - 1] if k else 0 : self.word_ends[k]] == asked[i]:
                low[i], high[i] = self.ends[k - 1] if k else 0, self.ends[k]
        return low, high

    def open(self) -> None:
        """Ones before each place and the impacts in the order of each level."""
        n = len(self.impacts)
        width = -(-n // 8)
        self.ones = np.zeros((self.depth, n + 1), np.int32)
        self.level = np.zeros((self.depth + 1, n), np.int32)
        self.level[0] = self.impacts
        for k in range(self.depth):
            one = np.unpackbits(self._bits[k * width : (k + 1) * width], count=n, bitorder="little").view(bool)
            np.cumsum(one, out=self.ones[k, 1:])
            zeros = n - self.ones[k, n]
            self.level[k + 1, :zeros], self.level[k + 1, zeros:] = self.level[k][~one], self.level[k][one]
        self.zeros = n - self.ones[:, n].astype(np.int64)


@dataclass
class Asked:
    """The items of a pass: their ids, and by item the places of its distinct terms and how often it has each."""

    items: list
    terms: list[bytes]
    ends: np.ndarray
    term: np.ndarray
    times: np.ndarray
    weight: np.ndarray | None = None
    _hashed: dict[int, np.ndarray] = field(default_factory=dict)

    def hashed(self, seed: int) -> np.ndarray:
        """The terms' hashes in shards of a seed."""
        if seed not in self._hashed:
            sizes = np.array([len(t) for t in self.terms], np.int64)
            ends = np.cumsum(sizes)
            self._hashed[seed] = hashes(np.frombuffer(b"".join(self.terms), np.uint8), ends - sizes, ends, seed)
        return self._hashed[seed]


def ask(rows: list[tuple]) -> Asked:
    """Asked of (item_id, text) rows."""
    place: dict[bytes, int] = {}
    ends, term, times = [], [], []
    for _, text in rows:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        starts, to = terms(raw, np.zeros(1, np.int64))
        raw = _LOWER[raw].tobytes()
        own: dict[int, int] = {}
        for s, e in zip(starts.tolist(), to.tolist(), strict=True):
            k = place.setdefault(raw[s:e], len(place))
            own[k] = own.get(k, 0) + 1
        term += own.keys()
        times += own.values()
        ends.append(len(term))
    return Asked([r[0] for r in rows], list(place), np.array(ends, np.int64), np.array(term, np.int64), np.array(times, np.int64))


class Best:
    """The best ``k`` (score, doc) of each item so far, also the bar that a node has to pass."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.doc = np.zeros((items, k), np.int64), np.full((items, k), np.iinfo(np.int64).min)

    def passes(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a score of a document of this id or a larger one can be among the best."""
        bar = self.score[item, -1]
        return (score > bar) | ((score == bar) & (doc < self.doc[item, -1]))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Takes (item, score, doc) rows in."""
        some = np.unique(item)
        full = self.score[some] > 0
        item = np.concatenate([item, np.repeat(some, self.k)[full.ravel()]])
        score, doc = np.concatenate([score, self.score[some][full]]), np.concatenate([doc, self.doc[some][full]])
        by = np.lexsort((doc, -score, item))
        item, score, doc = item[by], score[by], doc[by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.score[item[keep], place[keep]], self.doc[item[keep], place[keep]] = score[keep], doc[keep]


def search_shard(shard: Shard, asked: Asked, best: Best, width: int = WIDTH) -> None:
    """Adds a shard's documents to the best of each item.

    A node is a range of documents with, for each of the item's terms, the part
    of its list that lies in the range; as the list keeps its order, the first
    posting of the part has its largest impact, and the sum over the terms bounds
    every document below. The nodes of the best bounds are opened first; those
    that can't pass the bar are dropped; a node of one document has its score.
    """
    low, high = shard.lists(asked.hashed(shard.seed), asked.terms)
    if not (high > low).any():
        return
    shard.open()
    for first in range(0, len(asked.ends), TOGETHER):
        _search(shard, asked, best, width, low, high, first, min(len(asked.ends), first + TOGETHER))


def _search(shard: Shard, asked: Asked, best: Best, width: int, low: np.ndarray, high: np.ndarray, first: int, last: int) -> None:
    at = np.arange(asked.ends[first - 1] if first else 0, asked.ends[last - 1])
    item = np.searchsorted(asked.ends, at, "right")
    term, w = asked.term[at], asked.times[at] * asked.weight[asked.term[at]]
    here = (high[term] > low[term]) & (w > 0)
    item, lo, hi, w = item[here], low[term[here]], high[term[here]], w[here]
    if not len(item):
        return
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    # nodes: item, level, first document, bound, and the end of its rows of (lo, hi, w)
    n_item, n_level, n_doc, n_bound = item[start], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.add.reduceat(w * shard.level[0][lo], start)
    n_end = np.append(start[1:], len(item))
    while len(n_item):
        # of each item the best open nodes
        by = np.lexsort((-n_bound, n_item))
        place = np.arange(len(by)) - np.searchsorted(n_item[by], n_item[by])
        now = np.zeros(len(by), bool)
        now[by[place < width]] = True
        rows, to = _ragged(n_end, np.flatnonzero(now))
        node = np.repeat(np.flatnonzero(now), np.diff(to, prepend=0))
        level, a, b, weight = n_level[node], lo[rows], hi[rows], w[rows]
        ones_a, ones_b = shard.ones[level, a].astype(np.int64), shard.ones[level, b].astype(np.int64)
        zeros = shard.zeros[level]
        a2, b2 = np.concatenate([a - ones_a, zeros + ones_a]), np.concatenate([b - ones_b, zeros + ones_b])
        node2, one, weight = np.concatenate([node, node]), np.repeat([0, 1], len(node)), np.concatenate([weight, weight])
        full = b2 > a2
        a2, b2, node2, one, weight = a2[full], b2[full], node2[full], one[full], weight[full]
        part = weight * shard.level[n_level[node2] + 1, a2]
        start = np.flatnonzero(np.concatenate([[True], (node2[1:] != node2[:-1]) | (one[1:] != one[:-1])]))
        c_bound, of, side = np.add.reduceat(part, start), node2[start], one[start]
        c_item, c_level = n_item[of], n_level[of] + 1
        c_doc = n_doc[of] + (side << (shard.depth - c_level))
        c_end = np.append(start[1:], len(node2))
        leaf = c_level == shard.depth
        hit = leaf & best.passes(c_item, c_bound, shard.doc_ids[c_doc])
        if hit.any():
            best.add(c_item[hit], c_bound[hit], shard.doc_ids[c_doc[hit]])
        stay, grow = ~now, ~leaf
        stay &= best.passes(n_item, n_bound, shard.doc_ids[n_doc])
        grow &= best.passes(c_item, c_bound, shard.doc_ids[c_doc])
        kept, kept_to = _ragged(n_end, np.flatnonzero(stay))
        more, more_to = _ragged(c_end, np.flatnonzero(grow))
        lo, hi, w = np.concatenate([lo[kept], a2[more]]), np.concatenate([hi[kept], b2[more]]), np.concatenate([w[kept], weight[more]])
        n_end = np.concatenate([kept_to, more_to + (kept_to[-1] if len(kept_to) else 0)])
        n_item, n_level, n_doc, n_bound = (np.concatenate([x[stay], y[grow]]) for x, y in ((n_item, c_item), (n_level, c_level), (n_doc, c_doc), (n_bound, c_bound)))


def _pass(shards: DataFrame, asked: Asked, n_docs: int, k: int) -> DataFrame:
    """item (its place in asked), doc_id, score: the best k of what each task has searched."""

    def count(batches):
        total = np.zeros(len(asked.terms), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                low, high = (s := Shard({c: b.column(c)[i].as_py() for c in b.schema.names})).lists(asked.hashed(s.seed), asked.terms)
                total += high - low
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(total[some], pa.int64())})

    parts = shards.drop("doc_ids", "impacts", "bits").mapInArrow(count, "term long, df long")
    df = np.zeros(len(asked.terms), np.int64)
    for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for a term of this pass's items
        df[r["term"]] = r["df"]
    asked.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def run(batches):
        best = Best(len(asked.items), k)
        for b in batches:
            for i in range(b.num_rows):
                search_shard(Shard({c: b.column(c)[i].as_py() for c in b.schema.names}), asked, best)
        item, place = np.nonzero(best.score)
        doc = best.doc[item, place]
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=doc == _NONE), "score": pa.array(best.score[item, place], pa.int64())})

    return shards.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs (doc_id, text) for each row of items (item_id, text).

    The formula is that of BM25 in whole numbers: w = floor(1000 * ln((2N + 2) /
    (2 df + 1))) and m = 75 + (25 n N) div L; a document scores the sum of w *
    ((1000000000 tf) div (1000 tf + 12 m)) over the item's terms with repeats.
    Results are exact: a range of documents is left out only if its bound can't
    pass the k-th best found. Items are a stated set of queries, ``block`` of them in a pass over
    the shards. Null texts are empty; items without a known term have no rows;
    equal scores go by doc_id, null last; repeated documents are documents of
    their own, and repeated items count once. A text of any length is one
    document. Empty tables give an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    asked = stored(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct())
    shards, n_docs, n_terms = build_index(docs, shard_bytes)
    passes = max(1, -(-asked.count() // block))
    kind = items.schema["item_id"].dataType.simpleString()
    found = []
    for i in range(passes):
        rows = sorted(((r["item_id"], r["text"]) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()), key=str)
        q = ask(rows)
        hits = _pass(shards, q, n_docs, k)
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], f"item long, item_id {kind}")
        found.append(stored(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    release(asked, shards)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the 20 best documents of each benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH toks AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
docs AS (SELECT d, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM toks GROUP BY d),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM docs),
tfs AS (SELECT d, term, count(*)::BIGINT AS tf FROM toks GROUP BY d, term),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
scored AS (
  SELECT item_id, docs.doc_id, sum(times * floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN docs USING (d) CROSS JOIN totals GROUP BY item_id, d, docs.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
