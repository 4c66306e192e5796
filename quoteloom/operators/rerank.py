"""Rerankers, the rules around them, and scope matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .retrieval import ranked

LEXICAL_WEIGHT, TOP_N, ABSTAIN_BELOW = 0.5, 10, 0.0
SKIP_TOP, SKIP_MARGIN = 0.85, 0.20
SCOPE_WEIGHT, SCOPE_THRESHOLD = 0.65, 0.55
Scorer = Callable[[Column, Column], Column]


def keep_or_all(cands: DataFrame, keep: str = "keep", by: str = "line") -> DataFrame:
    """Candidates that a filter keeps; all of a line's if it would keep none."""
    some = F.max(F.col(keep)).over(Window.partitionBy(by))
    return cands.withColumn("_some", some).where(F.col(keep) | ~F.col("_some")).drop("_some")


def lexical(cands: DataFrame, n: int = TOP_N, score: Scorer = T.similarity) -> DataFrame:
    """(line, query, doc, text, ord) -> the best n a line by the best similarity over its queries; without a query the first n."""
    usable = F.length(T.normalize_desc(F.col("query"))) >= 2
    scored = cands.withColumn("s", F.when(usable, F.round(score(F.col("query"), F.col("text")), 6)))
    best = scored.groupBy("line", "doc").agg(F.max("s").alias("score"), F.min("ord").alias("ord"))
    return ranked(best, "line", F.desc_nulls_last("score"), F.asc("ord"), F.asc("doc")).where(F.col("rank") <= n)


def with_margin(rows: DataFrame) -> DataFrame:
    """Ranked rows with the line's top score and its lead over the second (0 for a single row)."""
    w = Window.partitionBy("line").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value("score", 2).over(w)
    return rows.withColumn("top1", F.first("score").over(w)).withColumn("margin", F.round(F.coalesce(F.first("score").over(w) - second, F.lit(0.0)), 6))


def hybrid(cands: DataFrame, n: int | None = TOP_N, weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """(line, doc, lex, cos, penalty, ord) -> weight * lex + (1 - weight) * max(0, cos) - penalty, the best n (all without one), with top1 and margin."""
    score = F.round(weight * F.coalesce("lex", F.lit(0.0)) + (1 - weight) * F.greatest(F.lit(0.0), F.coalesce("cos", F.lit(0.0))) - F.coalesce("penalty", F.lit(0.0)), 6)
    rows = ranked(cands.withColumn("score", score), "line", F.desc("score"), F.asc("ord"), F.asc("doc"))
    return with_margin(rows if n is None else rows.where(F.col("rank") <= n))


def skip_model(top1: Column, margin: Column, t: float = SKIP_TOP, m: float = SKIP_MARGIN) -> Column:
    """Whether the first ranking is sure enough to do without the pair scorer."""
    return (top1 >= t) & (margin >= m)


def cross_encoder(cands: DataFrame, scorer: Scorer | None, n: int | None = TOP_N, abstain: float = ABSTAIN_BELOW) -> DataFrame:
    """(line, query, doc, text, penalty, ord) by a pair scorer less the penalty, the best n (all without one); blank texts score 0; abstain flags a low top.

    Without a scorer the result is empty: the caller keeps its ranking.
    """
    raw = F.lit(None).cast("double") if scorer is None else F.when(T.canonical(F.col("text")) == "", 0.0).otherwise(scorer(F.col("query"), F.col("text")))
    rows = cands if scorer is not None else cands.where("false")
    out = ranked(rows.withColumn("score", F.round(raw - F.coalesce("penalty", F.lit(0.0)), 6)), "line", F.desc("score"), F.asc("ord"), F.asc("doc"))
    out = out if n is None else out.where(F.col("rank") <= n)
    top = F.max("score").over(Window.partitionBy("line"))
    return out.withColumn("abstain", top < abstain)


def rerank(cands: DataFrame, scorer: Scorer | None = None, cap: int = TOP_N, excluded: DataFrame | None = None, weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """hybrid(), but the pair scorer over all candidates of the lines that it isn't sure of; the best ``cap`` a line.

    pool_size() candidates are ranked before the excluded items (line, item_key;
    cands have item_key then) go and the cap cuts. by_model tells whether the
    pair scorer gave the score; weight is that of the lexical score.
    """
    first = hybrid(cands, None, weight).withColumn("abstain", F.lit(False)).withColumn("by_model", F.lit(False))
    if scorer is not None:
        sure = skip_model(F.col("top1"), F.col("margin"))
        open_ = first.where(~sure & (F.col("rank") == 1)).select("line")
        second = cross_encoder(cands.join(open_, "line", "left_semi"), scorer, None).withColumn("by_model", F.lit(True))
        keep = second.columns
        first = first.where(sure).select(*keep).unionByName(second)
    n = F.count("*").over(Window.partitionBy("line"))
    pool = first.withColumn("_n", n).where(F.col("rank") <= pool_size(F.col("_n"), cap, excluded is not None))
    if excluded is not None:
        pool = exclude(pool, excluded, cap)
    return pool.where(F.col("rank") <= cap).select("line", "doc", "score", "rank", "abstain", "by_model")


def exclude(rows: DataFrame, excluded: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` ranked rows a line without its excluded items (line, item_key); all if nothing would be left."""
    marked = rows.join(excluded.select("line", "item_key").distinct().withColumn("_x", F.lit(True)), ["line", "item_key"], "left")
    kept = keep_or_all(marked.withColumn("keep", F.col("_x").isNull())).drop("keep", "_x")
    return ranked(kept.drop("rank"), "line", F.desc("score"), F.asc("doc")).where(F.col("rank") <= cap)


def pool_size(n: Column, cap: int, excluding: bool = False) -> Column:
    """How many candidates are ranked before the cap."""
    return F.least(n, F.lit(max(50, 10 * cap) if excluding else max(12, 5 * cap)))


def merged_cap(cands: DataFrame) -> DataFrame:
    """The most candidates a line has, between 2 and 12."""
    most = cands.groupBy("line").count().agg(F.max("count").alias("m"))
    return most.select(F.least(F.greatest(F.coalesce("m", F.lit(0)), F.lit(2)), F.lit(12)).alias("cap"))


def stages(**named: DataFrame) -> DataFrame:
    """For each line and stage the documents in rank order: what a trace of a query shows."""
    parts = [df.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda r: r.doc.cast("string")).alias("docs")).withColumn("stage", F.lit(k)) for k, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("line", "stage", "docs")


def scope_match(pairs: DataFrame, weight: float = SCOPE_WEIGHT, threshold: float = SCOPE_THRESHOLD) -> DataFrame:
    """(line, scope_idx, scope_text, cos, bm25) -> for each line its best scope item and whether it is in scope.

    BM25 counts as a share of the line's best one; of equal scores the first item wins.
    """
    top = F.max("bm25").over(Window.partitionBy("line"))
    norm = F.when(top > 0, F.col("bm25") / top).otherwise(0.0)
    score = F.round(weight * F.greatest(F.lit(0.0), F.col("cos")) + (1 - weight) * norm, 4)
    best = pairs.withColumn("score", score).groupBy("line").agg(F.max(F.struct("score", (-F.col("scope_idx")).alias("k"), "scope_text")).alias("b"))
    inside = F.col("b.score") >= threshold
    return best.select("line", inside.alias("in_scope"), F.col("b.score").alias("confidence"), F.when(inside, F.col("b.scope_text")).alias("matched_scope_text"), F.lit("hybrid").alias("method"))
