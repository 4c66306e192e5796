"""Keeps a description index up to date from a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.retrieval import hash_embed
from ..stores.snapshots import SnapshotTable

SCHEMA = "company_tab string, canonical_desc string, vec array<double>"
KEYS = ("company_tab", "canonical_desc")


def index_table(spark: SparkSession, index_path: str) -> SnapshotTable:
    """The index as a table of snapshots."""
    return SnapshotTable(spark, index_path, SCHEMA, KEYS)


def extend(lines: DataFrame, index: SnapshotTable) -> int:
    """Embeds and adds the descriptions of lines that the index lacks; returns how many. What is there is never rewritten, and of two writers none adds a row twice."""
    wanted = lines.select("company_tab", T.canonical(T.folded(F.col("item_description"))).alias("canonical_desc")).where("canonical_desc <> ''").distinct()
    at = index.version()
    return index.append(index.missing(wanted, at).withColumn("vec", hash_embed(T.tokens(F.col("canonical_desc")))), at)


def follow(stream: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Applies extend() to each micro-batch that is there, then stops; a batch that comes twice adds nothing."""
    add = lambda df, _: extend(df, index_table(df.sparkSession, index_path))
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
