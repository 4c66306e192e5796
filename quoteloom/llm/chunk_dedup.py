"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import documents, row_struct, salted_lookup, stored
from .textkit import _TABLE

#: Mean bytes between the cuts that content defines, and the most and least bytes of a chunk.
MEAN, LEAST, MOST = 4096, 1024, 65536
#: Bytes that decide on a cut.
WINDOW = 32
#: Bytes that are hashed at once.
STEP = 1 << 20


def cuts(raw: bytes) -> list[int]:
    """Ends of a text's chunks; they depend on the WINDOW bytes before them, so equal passages are cut alike."""
    marks = []
    for at in range(0, len(raw), STEP):
        lead = min(at, WINDOW - 1)
        h = _TABLE[np.frombuffer(raw[at - lead : at + STEP], np.uint8)].astype(np.uint32)
        width = 1
        while width < WINDOW:
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint32(width)
            h, width = wider, width * 2
        marks.append(np.flatnonzero(h[lead:] >> np.uint32(8) < np.uint32((1 << 24) // MEAN)) + at + 1)
    out, last = [], 0
    for m in np.concatenate(marks).tolist() if marks else []:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < len(raw):
            out.append(m)
            last = m
    while len(raw) - last > MOST:
        last += MOST
        out.append(last)
    return [*out, len(raw)]


def chunks(raw: bytes) -> Iterator[bytes]:
    """The chunks of a text, in order; an empty text has one empty chunk."""
    last = 0
    for end in cuts(raw):
        yield raw[last:end]
        last = end


def _hash(chunk: bytes, bits: int) -> int:
    """A signed 64-bit identifier; fewer bits in tests, to see collisions."""
    h = xxhash.xxh3_64_intdigest(chunk) & ((1 << bits) - 1)
    return h - (1 << 64) if h >> 63 else h


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    for t in b.column("text"):
        yield (t.as_py() or "").encode("utf-8", "surrogatepass")


def _recipes(bits: int, names: list[str]):
    def run(batches):
        for b in batches:
            lists = [[_hash(c, bits) for c in chunks(raw)] for raw in _texts(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lists, pa.list_(pa.int64()))], [*names, "recipe"])

    return run


def _chunk_rows(bits: int):
    def run(batches):
        for b in batches:
            seen: dict[int, bytes] = {}
            for raw in _texts(b):
                for c in chunks(raw):
                    h = _hash(c, bits)
                    if seen.setdefault(h, c) != c:
                        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([c], pa.binary())], ["h", "chunk"])
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], ["h", "chunk"])

    return run


def _key() -> Column:
    """What tells a row from others, the same in any reading: doc_id and the text's hash."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def _grouped(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept of each row of docs (doc_id, text)."""
    rows = docs.select(_key().alias("key"), "doc_id", "text")
    recipes = rows.mapInArrow(_recipes(bits, rows.columns), StructType([*rows.schema.fields, StructField("recipe", ArrayType(LongType()))]))
    known = rows.select("text").mapInArrow(_chunk_rows(bits), "h long, chunk binary").distinct()
    clashes = stored(known.groupBy("h").count().where("count > 1").select("h"))
    exact = F.lit(None).cast("string")
    if clashes.limit(1).count():
        hit = recipes.select("key", F.explode("recipe").alias("h")).distinct().join(clashes, "h", "left_semi").select("key", F.lit(True).alias("clash")).distinct()
        recipes = recipes.join(hit, "key", "left")
        exact = F.when(F.col("clash"), F.coalesce("text", F.lit("")))
    # stored with the rows' numbers, so that a row's number stays what it is
    slim = stored(recipes.select(F.monotonically_increasing_id().alias("row"), "key", "doc_id", F.struct("recipe", exact.alias("exact")).alias("content")))
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = slim.groupBy("content").agg(best, F.count("*").alias("group_size")).where("group_size > 1").select("content", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("best.row").alias("keep_row"))
    out = salted_lookup(slim, groups, "content", "row")
    alone = F.col("group_size").isNull()
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True))
    return out.select("doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))


def dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (doc_id, text).

    Texts are cut into content-defined chunks. Distinct chunks (the bytes
    themselves) are compared once, which proves that an identifier stands for
    one content; from then on only the ordered lists of identifiers move. An
    identifier that stood for two contents would be replaced by the text itself
    for the documents that hold it. Null counts as empty. The row with the
    largest doc_id stays; of repeated rows with that very doc_id one is kept,
    and a null doc_id is the smallest. Whole texts count, however long. Other
    columns aren't read; an empty table gives an empty result.
    """
    return _grouped(docs, bits).select("doc_id", "keep_id", "group_size", "kept", F.substring_index("key", ":", -1).alias("text_sha256"))


def keep_rows(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The rows that dedup() keeps, with all columns of docs, of any name.

    Of rows that agree in doc_id and text one stays, whichever: they differ in
    other columns at most.
    """
    fate = stored(_grouped(docs, bits).groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    rows = docs.select(_key().alias("key"), row_struct(docs).alias("_row")).join(fate.where("not kept").select("key").hint("merge"), "key", "left_anti")
    again = fate.where("kept and n > 1").select("key").hint("merge")
    if again.limit(1).count():
        once = rows.join(again, "key", "left_semi").groupBy("key").agg(F.first("_row").alias("_row"))
        rows = rows.join(again, "key", "left_anti").unionByName(once)
    return rows.select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents."""
    return dedup(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
