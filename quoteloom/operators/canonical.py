"""Canonical descriptions and the item codes that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T


def registry(lines: DataFrame, description: str = "item_description", loose: bool = False) -> DataFrame:
    """canonical_desc -> sorted distinct item keys; blanks don't count."""
    canon = (T.canonical_loose if loose else T.canonical)(T.folded(F.col(description)))
    rows = lines.select(canon.alias("canonical_desc"), S.item_key(F.col("item_no")).alias("item_key")).where("canonical_desc <> '' AND item_key <> ''").distinct()
    return rows.groupBy("canonical_desc").agg(F.array_sort(F.collect_list("item_key")).alias("item_keys"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two registries."""
    rows = a.unionByName(b).select("canonical_desc", F.explode("item_keys").alias("k")).distinct()
    return rows.groupBy("canonical_desc").agg(F.array_sort(F.collect_list("k")).alias("item_keys"))


def summary(reg: DataFrame) -> DataFrame:
    """Number of descriptions, of codes, and of codes of the description with most."""
    n = F.size("item_keys")
    return reg.agg(F.count("*").alias("n_descriptions"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_codes"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_codes"))


def lookup(reg: DataFrame, queries: DataFrame, loose: bool = False) -> DataFrame:
    """queries (line_id, text) with the expected item keys of their canonical text."""
    canon = (T.canonical_loose if loose else T.canonical)(T.folded(F.col("text")))
    return queries.withColumn("canonical_desc", canon).join(reg, "canonical_desc", "left").withColumn("item_keys", F.coalesce("item_keys", F.array().cast("array<string>")))
