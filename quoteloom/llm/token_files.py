"""Token ids in Re-Pair compressed shards, with random access."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, shared_folder
from .tokens import encoder

#: Id that ends a document.
END = 2
#: Tokens of a shard, about: a shard is closed by the first document that reaches it.
SHARD_TOKENS = 1 << 20
#: Pairs that a round replaces at most, and the least count of a pair that is worth a rule.
PAIRS, LEAST = 1 << 17, 2
MAGIC = b"QLRP0002"
_SLOTS = 20
#: Places beyond which a round sorts pairs together with their places.
SORTED = 1 << 16


@dataclass
class Shard:
    """A grammar and the documents it spells: symbols[marks[i]:marks[i+1]] expand to document i.

    Symbols below ``first`` are ids, symbol first + k is rule k: the symbols
    left[k] and right[k], which are older, and spell expansion[k] ids.
    """

    first: int
    left: np.ndarray
    right: np.ndarray
    expansion: np.ndarray
    symbols: np.ndarray
    doc_ids: np.ndarray
    known: np.ndarray
    marks: np.ndarray
    starts: np.ndarray

    def _kinds(self) -> list[tuple[str, str]]:
        sym = "<u2" if self.first + len(self.left) <= 1 << 16 else "<u4"
        return [("left", sym), ("right", sym), ("expansion", "<u4"), ("doc_ids", "<i8"), ("known", "<u1"), ("marks", "<u8"), ("starts", "<u8"), ("symbols", sym)]

    def to_bytes(self) -> bytes:
        """Little-endian: magic, first nonterminal, three counts, rules, expansion lengths, documents (id, whether it has one, first symbol, first token), symbols."""
        head = struct.pack("<4Q", self.first, len(self.left), len(self.doc_ids), len(self.symbols))
        return MAGIC + head + b"".join(getattr(self, n).astype(k).tobytes() for n, k in self._kinds())

    @staticmethod
    def from_bytes(raw: bytes) -> Shard:
        """Reads what to_bytes() wrote."""
        if raw[:8] != MAGIC:
            raise ValueError("not a shard")
        first, rules, docs, symbols = struct.unpack("<4Q", raw[8:40])
        n = {"left": rules, "right": rules, "expansion": rules, "doc_ids": docs, "known": docs, "marks": docs + 1, "starts": docs + 1, "symbols": symbols}
        out = Shard(first, np.zeros(rules), *[np.zeros(0)] * 7)
        at, got = 40, {}
        for name, kind in out._kinds():
            got[name] = np.frombuffer(raw, kind, n[name], at)
            at += n[name] * int(kind[-1])
        return Shard(first, **got)

    @cached_property
    def _size_of(self) -> np.ndarray:
        return np.concatenate([np.ones(self.first, np.int64), self.expansion.astype(np.int64)])

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol spells."""
        return self._size_of.take(symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols spell: expansion lengths tell where each side of a rule goes, level by level."""
        s = symbols.astype(np.int64)
        sizes = self._sizes(s)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        at = ends - sizes
        left, right = self.left.astype(np.int64), self.right.astype(np.int64)
        while len(s):
            rule = s >= self.first
            done, rule = np.flatnonzero(~rule), np.flatnonzero(rule)
            out[at.take(done)] = s.take(done)
            if not len(rule):
                break
            k, at = s.take(rule) - self.first, at.take(rule)
            a = left.take(k)
            s, at = np.concatenate([a, right.take(k)]), np.concatenate([at, at + self._sizes(a)])
        return out

    def documents(self) -> list[np.ndarray]:
        """The ids of all documents, in order."""
        return np.split(self.expand(self.symbols), self.starts[1:-1].astype(np.int64)) if len(self.doc_ids) else []

    def document(self, i: int) -> np.ndarray:
        """The ids of one document; the others aren't expanded."""
        return self.expand(self.symbols[int(self.marks[i]) : int(self.marks[i + 1])])

    def read(self, i: int, start: int, n: int) -> np.ndarray:
        """ids[start:start + n] of a document: expansion lengths find the symbols that cover them."""
        s = self.symbols[int(self.marks[i]) : int(self.marks[i + 1])].astype(np.int64)
        ends = np.cumsum(self._sizes(s))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + n) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(s[a:b])[skip : skip + n]


def _ranked(x: np.ndarray, y: np.ndarray, at: np.ndarray, places: int, wide: int, long: int, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The pairs that occur often enough, most frequent first, the rank of the pair at each place (-1: none of them), and whether these are all such pairs.

    Symbols have ``wide`` bits and places ``long``, so that one sort of words of
    64 bits brings equal pairs together with their places.
    """
    wide, long = np.uint64(wide), np.uint64(long)
    word = x.astype(np.uint64)  # in place from here on: these are the largest arrays of a round
    word <<= wide
    word |= y
    word <<= long
    word |= at.view(np.uint64)
    word.sort()
    key = word >> long
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(starts, len(word)))
    good = np.flatnonzero(counts >= least)
    chosen = good[np.argsort(-counts[good], kind="stable")[:pairs]]
    group = np.full(len(starts), -1, np.int32)
    group[chosen] = np.arange(len(chosen), dtype=np.int32)
    rank = np.empty(places, np.int32)
    word &= (np.uint64(1) << long) - np.uint64(1)
    rank[word.view(np.int64)] = np.repeat(group, counts)
    found = key[starts[chosen]]
    return (found >> wide).astype(np.uint32), (found & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.uint32), rank.take(at), len(good) <= pairs


def re_pair(docs: list[tuple[int | None, np.ndarray]], pairs: int = PAIRS, least: int = LEAST) -> Shard:
    """Compresses documents: replaces the most frequent pairs of symbols by nonterminals until no pair occurs ``least`` times.

    Pairs don't reach across documents. A round replaces up to ``pairs`` of them
    at once; where chosen pairs overlap the more frequent one wins, and of a run
    of one symbol every second pair is taken. In rounds of few places a pair whose
    hash slot a more frequent one has waits for a later one. A round costs by the pairs that may
    still be replaced: symbols keep their places, linked to the next ones.
    """
    sizes = np.array([len(ids) for _, ids in docs], np.int64)
    seq = np.concatenate([ids for _, ids in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    left, right, length = [], [], []
    rules = 0
    known = np.zeros(0, np.int64)
    slots = np.zeros(1 << _SLOTS, np.int32)
    slot_of = lambda x, y: (x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _SLOTS)
    # where a pair starts that may occur often enough: counts only fall, so later rounds look at new symbols and what was left waiting
    alive = ~last
    after_, before_ = np.arange(1, len(seq) + 1, dtype=np.int32), np.arange(-1, len(seq) - 1, dtype=np.int32)
    gone = np.zeros(len(seq), bool)
    while True:
        at = np.flatnonzero(alive)
        x, y = seq.take(at), seq.take(after_.take(at))
        wide, long = int(first + rules).bit_length(), len(seq).bit_length()
        if len(at) > SORTED and 2 * wide + long <= 64:
            a, b, rank, whole = _ranked(x, y, at, len(seq), wide, long, pairs, least)
            if not len(a):
                break
            hit = rank >= 0
            if whole:
                alive[at] = hit
            hit = np.flatnonzero(hit)
            at, rank, none = at.take(hit), rank.take(hit), len(a)
        else:
            slot = slot_of(x, y)
            key = x.astype(np.uint64) << np.uint64(32) | y
            found, counts = np.unique(key, return_counts=True)
            good = counts >= least
            found, counts = found[good], counts[good]
            if not len(found):
                break
            whole = len(found) <= pairs
            found = found[np.argsort(-counts, kind="stable")[:pairs]]
            a, b = (found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32)
            own = slot_of(a, b)
            slots[own[::-1]] = np.arange(len(found), 0, -1)  # 1 + rank; the most frequent pair of a slot is written last
            rank = slots[slot]
            hit = rank > 0
            if whole:  # a slot of no pair that is frequent enough
                alive[at[~hit]] = False
            hit[hit] = found[rank[hit] - 1] == key[hit]
            slots[own] = 0
            at, rank, none = at[hit], rank[hit] - 1, len(found)
        near = at[1:] == after_[at[:-1]]
        before, after = np.full(len(at), none, np.int32), np.full(len(at), none, np.int32)
        before[1:] = np.where(near, rank[:-1], none)
        after[:-1] = np.where(near, rank[1:], none)
        heads = np.flatnonzero(np.concatenate([[True], ~near | (rank[1:] != rank[:-1])]))
        run = np.repeat(heads, np.diff(np.append(heads, len(at))))  # where its run of one pair starts
        odd = (np.arange(len(at)) - run + (before.take(run) < rank)) & 1
        chosen = np.flatnonzero((odd == 0) & (rank <= after))
        take, rank = at.take(chosen), rank.take(chosen)
        is_used = np.zeros(none, bool)
        is_used[rank] = True
        used, new = np.flatnonzero(is_used), (np.cumsum(is_used) - 1)[rank]
        sides = []
        for side in (a[used], b[used]):
            n = np.ones(len(side), np.int64)
            n[side >= first] = known[side[side >= first] - np.uint32(first)]
            sides.append(n)
        known = np.concatenate([known, sides[0] + sides[1]])
        left.append(a[used]), right.append(b[used]), length.append(known[rules:])
        seq[take] = (first + rules + new).astype(np.uint32)
        rules += len(used)
        dead = after_[take]
        gone[dead] = True
        last[take] = last[dead]
        after_[take] = beyond = after_[dead]
        inside = beyond < len(seq)
        before_[beyond[inside]] = take[inside]
        alive[take] = True
        ahead = np.maximum(before_[take], 0)
        alive[ahead] = True
        alive[dead] = False
        alive[take[last[take]]] = False
        alive[ahead] &= ~last[ahead]
    seq, last = seq[~gone], last[~gone]
    marks = np.zeros(len(docs) + 1, np.int64)
    filled = np.flatnonzero(sizes > 0)
    marks[1:][filled] = np.flatnonzero(last) + 1
    marks = np.maximum.accumulate(marks)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    ids = [i for i, _ in docs]
    return Shard(first, cat(left), cat(right), cat(length), seq, np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), marks, np.concatenate([[0], np.cumsum(sizes)]))


def _write(path: str | None):
    def run(batches):
        part = TaskContext.get().partitionId()
        enc = encoder(path)
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = before = 0

        def close():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "before": pa.array([before], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "payload": pa.array([re_pair(held).to_bytes()], pa.binary())})

        for b in batches:
            texts = (t.as_py() or "" for t in b.column("text"))
            for i, ids in zip(b.column("doc_id").to_pylist(), enc.encode_each(texts), strict=True):
                ids = np.append(ids, np.uint32(END))
                held.append((i, ids))
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield close()
                    before += size
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Writes the ids of docs (doc_id, text) to folder, in ascending doc_id order.

    A row of the folder's Parquet files is a shard: its place in the order
    (part, shard), the tokens of the part before it, its documents and tokens,
    and the payload of Shard.to_bytes(). Rows without doc_id come first; rows of
    one doc_id are ordered by their text's hash, then the text, and repeated rows
    are written as often as they come. Null texts are empty and have the end id
    alone. Other columns aren't read; an empty table writes no shard. A document
    is never split, so memory follows the longest document or SHARD_TOKENS.
    """
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(_write(path), "part int, shard int, before long, n_docs long, n_tokens long, payload binary").write.parquet(folder)


def _read(batches):
    for b in batches:
        for base, raw in zip(b.column("base").to_pylist(), b.column("payload"), strict=True):
            s = Shard.from_bytes(raw.as_py())
            got = s.documents()
            starts = s.starts[:-1].astype(np.int64) + base
            ids = pa.array(s.doc_ids, pa.int64(), mask=s.known == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array([len(d) for d in got], pa.int64()), pa.array([zlib.crc32(d.astype("<u4", copy=False)) for d in got], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in a folder of write_tokens(), decoded from the files.

    The table that is broadcast has a row a part, that is a task of the write,
    however many documents there are; the payloads aren't shuffled.
    """
    shards = spark.read.parquet(folder)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    rows = shards.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("base"), "payload")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: writes all documents and reads them back."""
    folder = shared_folder(spark)
    write_tokens(documents(spark, sf_dir), folder)
    return read_tokens(spark, folder)
