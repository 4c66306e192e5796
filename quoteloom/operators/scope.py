"""Which item of a scope of work each line belongs to, by meaning and by words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from . import retrieval as V
from .rerank import SCOPE_THRESHOLD, SCOPE_WEIGHT

#: Scope items that a task compares its lines with at once.
BLOCK = 20_000
Embedder = Callable[[Column], Column]


def _nearest(lines: DataFrame, scope: DataFrame, block: int) -> DataFrame:
    """lines (line, vec) x scope (scope_idx, vec) -> line, scope_idx: the scope item of the largest cosine, of equal ones the first."""
    n = scope.count()
    passes = max(1, -(-n // block))
    kind, out = lines.schema["line"].dataType.simpleString(), None
    for i in range(passes):
        got = scope.where(F.pmod(F.xxhash64("scope_idx"), F.lit(passes)) == i).orderBy("scope_idx").collect()
        ids = np.array([r["scope_idx"] for r in got], np.int64)
        m = np.array([r["vec"] for r in got], np.float64).reshape(len(got), len(got[0]["vec"]) if got else 0)
        m = m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) > 0, size, 1.0)

        def run(batches: Iterator[pd.DataFrame], m=m, ids=ids) -> Iterator[pd.DataFrame]:
            for p in batches:
                for low in range(0, len(p) if len(ids) else 0, 512):
                    part = p.iloc[low : low + 512]
                    x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                    size = np.linalg.norm(x, axis=1, keepdims=True)
                    cos = np.round(x / np.where(size > 0, size, 1.0) @ m.T, 9)
                    best = cos.argmax(1)
                    yield pd.DataFrame({"line": part["line"].to_numpy(), "scope_idx": ids[best], "cos": cos[np.arange(len(best)), best]})

        found = lines.mapInPandas(run, f"line {kind}, scope_idx long, cos double")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("line").agg(F.max(F.struct("cos", (-F.col("scope_idx")).alias("k"))).alias("b"))
    return best.select("line", (-F.col("b.k")).alias("scope_idx"))


def match_scope(lines: DataFrame, scope: DataFrame, embed: Embedder, weight: float = SCOPE_WEIGHT, threshold: float = SCOPE_THRESHOLD, block: int = BLOCK) -> DataFrame:
    """lines (line, description) x scope (scope_idx, scope_text) -> line, in_scope, confidence, matched_scope_text, method.

    The score of a pair is ``weight`` times the cosine of the texts' vectors (0 if
    negative) plus the rest times the BM25 score as a share of the line's best;
    the best item counts, of equal ones the first. Only pairs with a common term
    have a BM25 score, and of all others the nearest by vector is the best: these are
    the pairs that are looked at, not all. Blank scope texts are no items. Without
    an item every line has method ``empty_scope``; a blank description has
    ``empty_description``; both have confidence 0 and no text.
    """
    items = cut(scope.select(F.col("scope_idx").cast("long").alias("scope_idx"), F.trim(F.coalesce("scope_text", F.lit(""))).alias("scope_text")).where("scope_text <> ''"))
    lines = cut(lines.select("line", F.trim(F.coalesce("description", F.lit(""))).alias("description")))
    none = lambda method: (F.lit(False).alias("in_scope"), F.lit(0.0).alias("confidence"), F.lit("").alias("matched_scope_text"), F.lit(method).alias("method"))
    if not items.limit(1).count():
        return lines.select("line", *none("empty_scope"))
    # a description is compared once, however many lines have it
    asked = cut(lines.where("description <> ''").select(F.col("description").alias("line"), "description").distinct())
    index = V.bm25_index(items.select(F.col("scope_idx").alias("doc"), "scope_text"), T.tokens(F.col("scope_text")))
    words = V.bm25_scores(index, asked.select(F.col("line").alias("q"), T.tokens(F.col("description")).alias("terms")), 9).select(F.col("q").alias("line"), F.col("doc").alias("scope_idx"), "score")
    held = cut(items.select("scope_idx", "scope_text", embed(F.col("scope_text")).alias("vec")))
    vectors = cut(asked.select("line", embed(F.col("description")).alias("vec")))
    words = cut(words)
    near = _nearest(vectors, held, block)
    # the largest BM25 score is a share of 1 only if it is above 0
    top = words.groupBy("line").agg(F.max("score").alias("top"))
    pairs = words.unionByName(near.withColumn("score", F.lit(None).cast("double"))).groupBy("line", "scope_idx").agg(F.max("score").alias("score"))
    pairs = pairs.join(top, "line", "left").join(vectors.withColumnRenamed("vec", "a"), "line").join(held, "scope_idx")
    share = F.when(F.col("top") > 0, F.coalesce("score", F.lit(0.0)) / F.col("top")).otherwise(0.0)
    score = F.round(weight * F.greatest(F.lit(0.0), V.cosine(F.col("a"), F.col("vec"))) + (1 - weight) * share, 4)
    best = pairs.withColumn("s", score).groupBy("line").agg(F.max(F.struct("s", (-F.col("scope_idx")).alias("k"), "scope_text")).alias("b"))
    told = best.select("line", (F.col("b.s") >= threshold).alias("in_scope"), F.col("b.s").alias("confidence"), F.col("b.scope_text").alias("matched_scope_text"), F.lit("hybrid").alias("method"))
    told = lines.where("description <> ''").join(told.withColumnRenamed("line", "description"), "description").drop("description")
    return told.unionByName(lines.where("description = ''").select("line", *none("empty_description")))
