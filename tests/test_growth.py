"""What keeps the cost of a query in step with its input: each expression once, no pairs as rows, tasks that share a small file."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from quoteloom.functions import text as T
from quoteloom.operators import bestmatch, enrich
from quoteloom.operators import retrieval as V
from quoteloom.session import base_folder, cut
from quoteloom.stores.caches import PairScoreStore


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hash_embed_hashes_a_token_once(spark):
    df = spark.createDataFrame([("a b a c",), ("",)], "t string").repartition(1).select(V.hash_embed(T.tokens(F.col("t")), 8).alias("v"))
    assert plan(df).count("xxhash64(") == 1
    one, none = (r["v"] for r in df.collect())
    assert sum(x * x for x in one) == pytest.approx(1.0) and none == [0.0] * 8


@pytest.mark.parametrize("score", [T.token_score, T.similarity])
def test_scores_split_each_text_once(spark, score):
    df = spark.createDataFrame([("steel valve 20 mm", "valves of steel"), ("a", "b"), (None, "")], "a string, b string").repartition(1).select(score(F.col("a"), F.col("b")).alias("s"))
    assert plan(df).count("split(") <= 2
    assert all(0.0 <= r["s"] <= 1.0 for r in df.collect())


def test_by_tokens_in_blocks_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bestmatch, "QUERIES", 2)
    monkeypatch.setattr(bestmatch, "ROWS", 3)
    names = [f"{a} {b} {n} mm" for a in ("steel", "brass", "copper") for b in ("valve", "bolt", "steel") for n in (5, 12, 125)]
    asking = spark.createDataFrame([(x,) for x in [*names[::2], "valve", "none such", "", "of it"]], "description string")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*names[1::2], *names[1::4], "bolt valve", "", "it of"])], "doc long, item_description string")
    got = bestmatch.by_tokens(asking, rows, 0.1)
    assert "CoGroup" in plan(got)  # pairs of a query and a row are no rows of a join
    pairs = asking.crossJoin(rows).withColumn("sim", F.round(T.token_score(F.col("description"), F.col("item_description")), 6)).where("sim >= 0.1")
    want = {r["description"]: (r["b"]["sim"], -r["b"]["k"]) for r in pairs.groupBy("description").agg(F.max(F.struct("sim", (-F.col("doc")).alias("k"))).alias("b")).collect()}
    assert {r["description"]: (r["sim"], r["doc"]) for r in got.collect()} == want and len(want) > 10


def test_pick_row_scores_a_text_once_an_item(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def count(q, t):
        seen.add(1)
        return 0.5

    asked = spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], "line long, ref_item string, q string")
    rows = spark.createDataFrame([(i, "A", "same text", 1.0) for i in range(50)], "doc long, item_no string, item_description string, unit_cost double")
    got = enrich._same_item(asked, rows, lambda q, t: count(q, t)).collect()
    assert len(got) == 100 and {r["sim"] for r in got} == {0.5} and seen.value <= 2


def test_bm25_scores_meet_by_document(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 3}") for i in range(40)] + [(40, ""), (41, None)], "doc long, text string")
    index = V.bm25_index(docs, T.tokens(F.col("text")))
    asked = spark.createDataFrame([(q, ["common", f"word{q}", f"word{q}"]) for q in range(5)], "q long, terms array<string>")
    got = V.bm25_scores(index, asked, block=2)
    assert "MapInPandas" in plan(got)  # pairs of a query and a document are no rows of a join and its shuffle
    whole = {(r["q"], r["doc"]): r["score"] for r in got.collect()}
    assert len(whole) == 200 and index["lengths"].count() == 42
    top = V.bm25_topk(index, asked, k=4, block=2).collect()
    for q in range(5):
        want = sorted(((-whole.get((q, d), 0.0), d) for d in range(42)))[:4]
        assert [(-r["score"], r["doc"]) for r in sorted((r for r in top if r["q"] == q), key=lambda r: r["rank"])] == want


def test_vendor_key_local_has_names_with_suffixes(spark, sf):
    from quoteloom.functions import scalars as S
    from quoteloom.plans import catalogue

    got = catalogue.vendor_key_local(spark, sf)
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").count()
    ends = F.array(*[F.lit(x) for x in S.VENDOR_SUFFIXES])
    cut = got.where(F.exists(ends, lambda e: F.endswith(F.upper(F.trim("raw")), e)))
    assert cut.count() >= suppliers * len(S.VENDOR_SUFFIXES)
    # each loses its suffix; of "Corp Inc" INC alone, as CORP was tested before it
    assert cut.where(~F.col("vendor_key").rlike("^SUPPLIER[0-9]+(CORP)?$")).count() == 0
    assert got.where("vendor_key LIKE '%CORP' AND raw LIKE '% Corp Inc'").count() == suppliers


@pytest.mark.parametrize("name", ["benchmark_latest_by_item", "benchmark_lowest_by_item", "benchmark_before_window", "benchmark_window_fallback", "benchmark_other_vendor", "item_reference"])
def test_descriptions_join_lines_dealt_by_part(spark, sf, monkeypatch, name):
    from quoteloom.operators import benchmark
    from quoteloom.plans import catalogue
    from quoteloom.sources import erp

    got = catalogue.QUERIES[name](spark, sf)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    rows = plan(got).split("\n")
    at = next(i for i, line in enumerate(rows) if "RepartitionByExpression [l_partkey" in line)
    below = [line for line in rows[at + 1 :]]
    end = next((i for i, line in enumerate(below) if depth(line) <= depth(rows[at])), len(below))
    dealt = "\n".join(below[:end])
    assert "s_name" in dealt and "o_orderdate" in dealt and "p_name" not in dealt
    monkeypatch.setattr(catalogue, "lines", lambda s, d, by_part=False: benchmark.keyed(erp.erp_lines(s, d)))
    assert sorted(map(str, got.collect())) == sorted(map(str, catalogue.QUERIES[name](spark, sf).collect()))


def test_what_a_store_writes(spark):
    """The keys of the rows that are asked for aren't stored, only the table's."""
    folder = pathlib.Path(base_folder(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    store = PairScoreStore.fresh(spark, "m", "1", lambda: lambda pairs: [0.5] * len(pairs))
    pairs = spark.range(5000).select(F.concat(F.lit("steel pipe "), "id").alias("query"), F.concat(F.lit("copper pipe "), "id").alias("text"))
    before = held()
    out, n = store.scores(pairs)
    _, again = store.scores(pairs)
    assert (n, again, out.where("score = 0.5").count()) == (5000, 0, 5000)
    assert held() - before < 5000 * 110


def test_cut_is_compressed(spark):
    df = spark.range(20_000).select(F.lit("the same long description of a part, again and again").alias("text"), "id")
    folder = pathlib.Path(base_folder(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = held()
    assert cut(df).count() == 20_000
    assert held() - before < 20_000 * 20
