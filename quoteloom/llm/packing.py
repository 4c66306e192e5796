"""Order-preserving packing of token sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, documents
from .tokens import encoder, token_strings

#: Tokens of a sequence.
LENGTH = 2048
#: Id that ends a document.
END = 1
#: Penalties, in padding tokens: of a sequence, of a cut between sentences and of one within a sentence.
PER_SEQUENCE, AT_SENTENCE, IN_SENTENCE = 16.0, 8.0, 48.0
#: A sentence of more tokens may be cut every so many tokens.
FORCED = 64
#: Tokens after which the program looks for cuts that can't change any more. It bounds memory and leaves the result as it is.
HORIZON = 1 << 19

_ends: dict[str | None, np.ndarray] = {}


def sentence_ends(path: str | None) -> np.ndarray:
    """By id: whether a sentence may end after it."""
    if path not in _ends:
        _ends[path] = np.array([any(c in s for c in ".!?Ċ") for s in token_strings(path)])
    return _ends[path]


def best_backs(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """For each cut position the one before it on the cheapest way there.

    ``at`` are rising cut positions from 0 on, the last one the end, no two
    neighbours more than ``length`` apart; ``penalty`` is what a cut there costs.
    A window costs its padding up to ``length``, or none if it is a power of two.
    best[j] = min over i of best[i] + length - (at[j] - at[i]) + penalty[j], so
    the minimum of best[i] + at[i] over the reachable i is all a transition
    needs: a monotone queue gives it in constant time. Windows of a power of two
    are looked up by their start. Of equal costs the earliest start wins.
    """
    n = len(at)
    ends, begins, power = [], [], 1
    while power < length:
        want = at - power
        k = np.searchsorted(at, want)
        j = np.flatnonzero((want >= 0) & (at[np.minimum(k, n - 1)] == want))
        ends.append(j), begins.append(k[j])
        power *= 2
    order = np.argsort(np.concatenate(ends), kind="stable") if ends else []
    until = np.concatenate(ends)[order].tolist() if ends else []
    since = np.concatenate(begins)[order].tolist() if ends else []
    until.append(n)
    pos, cost = at.tolist(), (penalty + PER_SEQUENCE).tolist()
    best = [0.0] * n
    back = [0] * n
    keys, starts, head, e = [0.0], [0], 0, 0  # the queue begins at head
    for j in range(1, n):
        p = pos[j]
        reach = p - length
        while pos[starts[head]] < reach:
            head += 1
        low, i = keys[head] - reach, starts[head]
        while until[e] == j:
            k = since[e]
            if best[k] < low:
                low, i = best[k], k
            e += 1
        best[j] = low = low + cost[j]
        back[j] = i
        low += p
        while len(keys) > head and keys[-1] >= low:
            keys.pop()
            starts.pop()
        keys.append(low)
        starts.append(j)
    return back


def path(back: list[int], j: int) -> list[int]:
    """The cuts of the cheapest way to cut j."""
    out = []
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def settled(at: np.ndarray, back: list[int], length: int = LENGTH) -> int:
    """The last cut that the cheapest ways to all cuts have in common that a later window can start from."""
    live = set(range(int(np.searchsorted(at, at[-1] - length)), len(at)))
    while len(live) > 1:
        last = max(live)
        live.remove(last)
        live.add(back[last])
    return live.pop()


def choose_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions of the cuts that cost least; see best_backs()."""
    return at[path(best_backs(at, penalty, length), len(at) - 1)].tolist()


def pack(stream: Iterator[tuple[object, np.ndarray]], ends: np.ndarray, length: int = LENGTH, horizon: int = HORIZON) -> Iterator[tuple]:
    """(doc, ids) in order -> (doc, start, ids of the piece, doc_tokens, sequence, offset), in order.

    The cuts are those of one dynamic program over all documents, whatever the
    horizon: only cuts that every cheapest way has are made before the end.
    """
    docs: list[tuple[object, np.ndarray, int]] = []  # document, its ids, where it starts in the buffer (maybe before)
    size, sequence, due = 0, 0, horizon

    def flush(final: bool) -> Iterator[tuple]:
        nonlocal docs, size, sequence
        marks, costs = [np.zeros(1, np.int64)], [np.zeros(1)]
        for _, ids, at in docs:
            own = ids[max(0, -at) :]
            first = max(0, at)
            cut = np.flatnonzero(ends[own[:-1]]) + 1
            cost = np.full(len(cut) + 1, AT_SENTENCE)
            cut = np.append(cut, len(own))
            cost[-1] = 0.0
            gap = np.diff(np.concatenate([[0], cut]))
            if (gap > 2 * FORCED).any():
                extra = np.concatenate([np.arange(c - g + FORCED, c, FORCED) for c, g in zip(cut.tolist(), gap.tolist(), strict=True) if g > 2 * FORCED])
                cut = np.concatenate([cut, extra])
                cost = np.concatenate([cost, np.full(len(extra), IN_SENTENCE)])
                by = np.argsort(cut)
                cut, cost = cut[by], cost[by]
            marks.append(cut + first)
            costs.append(cost)
        places = np.concatenate(marks)
        back = best_backs(places, np.concatenate(costs), length)
        cuts = places[path(back, len(places) - 1 if final else settled(places, back, length))].tolist()
        done = cuts[-1] if cuts else 0
        last, k = 0, 0
        for end in cuts:
            offset = 0
            while last < end:
                doc, ids, at = docs[k]
                stop = min(end, at + len(ids))
                yield doc, last - at, ids[last - at : stop - at], len(ids), sequence, offset
                offset += stop - last
                last = stop
                if last == at + len(ids):
                    k += 1
            sequence += 1
        docs = [(d, ids, at - done) for d, ids, at in docs[k:]]
        size -= done

    for doc, ids in stream:
        docs.append((doc, ids, size))
        size += len(ids)
        if size >= due:
            yield from flush(False)
            due = size + horizon  # what isn't settled yet stays
    if docs:
        yield from flush(True)


def _run(path: str | None, length: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        enc, ends = encoder(path), sentence_ends(path)

        def stream():
            for b in batches:
                texts = (t.as_py() or "" for t in b.column("text"))
                for i, ids in zip(b.column("doc_id").to_pylist(), enc.encode_each(texts), strict=True):
                    yield i, np.append(ids, np.uint32(END))

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows = []
        for doc, start, ids, total, sequence, offset in pack(stream(), ends, length):
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, (part << 40) + sequence, offset))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep their order within a partition of the input, and a partition
    is packed on its own, so nothing is shuffled and only its last sequence may
    be short. Cuts are at the ends of documents or sentences; only a sentence of
    over 2 * FORCED tokens may be cut elsewhere. A null text is empty and has the
    end id alone. Repeated rows are packed as often as they come, each as its own
    document; a null doc_id stays null. A long document is held whole with what
    is packed around it. Equally cheap cuts are settled by the earliest start.
    Other columns aren't read; an empty table gives no piece. ``path`` is the vocabulary file
    (None: the public one as installed on each machine).
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_run(path, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents."""
    return pack_documents(documents(spark, sf_dir))
