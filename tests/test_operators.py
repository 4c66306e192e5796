import pytest
from pyspark.sql import functions as F

from quoteloom.functions import text as T
from quoteloom.operators import crossmatch as X
from quoteloom.operators import rerank as R
from quoteloom.operators import retrieval as V
from quoteloom.operators import workframe as W
from quoteloom.sources import erp
from quoteloom.streaming import index_delta

LINE = "item_no string, item_description string, unit_cost double, unit string, vendor string, po_number string, po_order_date string, qty double, project_name string, line_no int, doc long"


def frame(spark, rows):
    full = [(i, d, c, "ea", "VendorCo", f"PO-{k}", day, 1.0, "", 1, k) for k, (i, d, day, c) in enumerate(rows)]
    return spark.createDataFrame(full, LINE).withColumn("po_order_date", F.col("po_order_date").cast("date"))


def golden(name):
    day = "2024-06-01"
    return {
        "titanium cryogenic valve procurement": ([(str(i), "standard steel bracket assembly", day, 1.0) for i in range(599)] + [("599", "titanium cryogenic valve procurement unit", day, 1.0)], "599"),
        "hastelloy reactor flange specialty procurement": ([(f"S{i}", "carbon steel pipe sch40 line stock", day, 1.0) for i in range(40)] + [("TARGET", "hastelloy reactor flange specialty", day, 1.0)], "TARGET"),
        "copper press elbow 22mm": ([("CU-22", "copper press elbow 22mm type b", day, 1.0), ("CU-15", "copper press elbow 15mm type b", day, 1.0), ("PVC-22", "pvc elbow 22mm", day, 1.0), ("BR-1", "brass valve", day, 1.0)], "CU-22"),
    }[name]


@pytest.mark.parametrize("q", ["titanium cryogenic valve procurement", "hastelloy reactor flange specialty procurement", "copper press elbow 22mm"])
def test_golden_retrieval(spark, q):
    rows, want = golden(q)
    lines = spark.createDataFrame([(1, q)], "line int, description string")
    got = X.candidates(lines, frame(spark, rows), cap=10).orderBy("rank").collect()
    assert got[0]["item_no"] == want


def test_receipt_dedupe(spark):
    rows = [("X-1", "pump", "2022-01-01", 5.0), ("X-1", "pump", "2024-08-01", 5.0), ("X-1", "pump", "2023-01-01", 5.0), ("X-2", "pump", "2020-01-01", 5.0)]
    got = {r["item_no"]: str(r["po_order_date"]) for r in W.prepare(frame(spark, rows)).collect()}
    assert got == {"X-1": "2024-08-01", "X-2": "2020-01-01"}


def ranks(spark, docs):
    return spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(docs)], "q int, doc int, rank int")


@pytest.mark.parametrize(("a", "b", "want"), [([], [], []), ([0, 2, 1], [], [0, 2, 1]), ([], [1, 0], [1, 0]), ([0, 1, 2], [2, 0], [0, 2, 1])])
def test_rrf(spark, a, b, want):
    assert [r["doc"] for r in V.rrf(ranks(spark, a), ranks(spark, b)).orderBy("rank").collect()] == want


def test_rrf_source_and_cap(spark):
    got = {r["doc"]: r["source"] for r in V.rrf(ranks(spark, [0, 1]), ranks(spark, [1, 2])).collect()}
    assert got == {0: "bm25", 1: "hybrid", 2: "emb"}
    assert V.rrf(ranks(spark, range(20)), ranks(spark, range(20)), cap=5).count() == 5


def test_knn_is_exact_under_repartition(spark):
    vec = spark.range(300).select(F.col("id").alias("doc"), F.array(*[F.sin(F.col("id") * k + k) for k in range(1, 9)]).alias("vec"))
    q = vec.where("doc < 3").withColumnRenamed("doc", "q")
    one = V.knn(q, vec.coalesce(1), 5).orderBy("q", "rank").collect()
    many = V.knn(q, vec.repartition(7), 5).orderBy("q", "rank").collect()
    assert one == many and all(r["doc"] == r["q"] for r in one if r["rank"] == 1)


def test_cross_encoder(spark):
    rows = [(1, "q", 1, "alpha", 0.0, 1), (1, "q", 2, " !", 0.0, 2), (1, "q", 3, "beta", 5.0, 3)]
    c = spark.createDataFrame(rows, "line int, query string, doc int, text string, penalty double, ord int")
    got = R.cross_encoder(c, lambda q, t: F.length(t).cast("double")).orderBy("rank").collect()
    assert [(r["doc"], r["score"]) for r in got] == [(1, 5.0), (2, 0.0), (3, -1.0)] and not got[0]["abstain"]
    assert R.cross_encoder(c, None).count() == 0


def test_keep_all_if_none_is_kept(spark):
    c = spark.createDataFrame([(1, 1, False), (1, 2, False), (2, 3, True), (2, 4, False)], "line int, doc int, keep boolean")
    assert {r["doc"] for r in R.keep_or_all(c).collect()} == {1, 2, 3}


def test_exact_code_gate(spark):
    work = frame(spark, [("ABC-123", "carbon steel pipe sch40", "2024-01-01", 4500.0)])
    lines = spark.createDataFrame([(1, "ABC-123", "carbon steel pipe sch40"), (2, "ABC-123", "office stationery copier toner")], "line int, item_no string, description string")
    (r,) = X.exact_code(lines, work).collect()
    assert (r["line"], r["provenance"], r["confidence"], r["ref_unit_cost"]) == (1, "exact_code", 100.0, 4500.0)


def test_match_uses_answers_then_fallback(spark):
    work = frame(spark, [("A", "brass ball valve", "2024-01-01", 7.0), ("B", "rubber hose", "2024-01-01", 9.0)])
    lines = spark.createDataFrame([(1, 0, "Q1", "brass ball valve 2"), (2, 1, "Q2", "rubber hose black")], "line int, pos int, item_no string, description string")
    answers = spark.createDataFrame([('{"matches": [{"item_no": "Q1", "reference_item_no": "A", "reference_unit_cost": 7}]}',)], "answer string")
    got = {r["line"]: r for r in X.match(lines, work, answers).collect()}
    assert got[1]["provenance"] == "ai_tagged" and got[1]["ref_unit_cost"] == 7.0
    assert got[2]["provenance"] == "lexical_fallback" and got[2]["ref_item_no"] == "B"


def test_headers_and_prices(spark):
    df = spark.createDataFrame([("1", "x", "SAR 5", "9")], ["Stock Code", "Long  Description", "Offer Price", "Total Price"])
    out = erp.ensure_unit_cost(erp.rename_by_alias(df))
    assert out.columns[:2] == ["item_no", "item_description"] and out.first()["unit_cost"] == "SAR 5"


def test_partitioned_lines(spark, sf, tmp_path):
    e = erp.erp_lines(spark, sf)
    erp.write_lines(e, str(tmp_path / "lines"))
    got = erp.read_lines(spark, str(tmp_path / "lines"), "MSB")
    assert got.count() == e.where("company_tab = 'MSB'").count()


def test_index_follows_a_stream(spark, sf, tmp_path):
    src, index = str(tmp_path / "src"), str(tmp_path / "index")
    e = erp.erp_lines(spark, sf).select("company_tab", "item_description")
    e.write.parquet(src)
    want = e.select("company_tab", T.canonical(F.col("item_description"))).distinct().count()
    for k in range(2):
        index_delta.follow(spark.readStream.schema(e.schema).parquet(src), index, str(tmp_path / f"c{k}")).awaitTermination()
        assert index_delta.index_table(spark, index).read().count() == want


def test_candidates_use_attributes_and_vectors(spark):
    day = "2024-06-01"
    work = frame(spark, [("A", "submersible pump motor 24 v", day, 1.0), ("B", "submersible pump 240 v", day, 2.0), ("C", "faucet chrome", day, 3.0), *[(f"Z{k}", f"tap{k} adapter part", day, 4.0) for k in range(60)]])
    lines = spark.createDataFrame([(1, "submersible pump motor 240 v"), (2, "tap")], "line int, description string")
    meaning = lambda t: F.array(*[t.rlike(p).cast("double") for p in ("faucet|tap$", "pump", "adapter")])
    got = X.candidates(lines, work, embed=meaning).collect()
    assert {r["item_no"] for r in got if r["line"] == 1} >= {"B"} and not any(r["line"] == 1 and r["item_no"] == "A" for r in got)
    assert [r["item_no"] for r in got if r["line"] == 2 and r["rank"] == 1] == ["C"]
    top = X.candidates(lines, work, 1, excluded=spark.createDataFrame([(1, "B")], "line int, item_key string"), embed=meaning).where("line = 1").collect()
    assert [r["item_no"] for r in top] and top[0]["item_no"] != "B"


def test_match_looks_through_all_work(spark):
    work = frame(spark, [("A", "brass ball valve", "2024-01-01", 7.0), ("B", "rubber hose brown and a much longer text", "2024-01-01", 9.0), ("C", "zinc", "2024-01-01", 5.0)])
    lines = spark.createDataFrame([(1, 0, "Q1", "brass ball valve big"), (2, 1, "Q2", "zinc")], "line int, pos int, item_no string, description string")
    wrong = lambda q, t: F.length(t).cast("double")  # noqa: E731  # prefers B, which shares no word with the first line
    answers = spark.createDataFrame([('{"matches": [{"item_no": "Q2", "reference_unit_cost": 9}]}',)], "answer string")
    got = {r["line"]: r for r in X.match(lines, work, answers, T.token_score, 1, wrong).collect()}
    assert (got[1]["provenance"], got[1]["ref_item_no"]) == ("lexical_fallback", "A")
    assert (got[2]["provenance"], got[2]["ref_item_no"]) == ("ai_tagged", "C")  # not Q2, its own code


def test_rerank_scores_all_candidates(spark):
    rows = [(1, "q", k, "x" * (100 - k if k < 60 else 500), 0.5 - k / 1000, 0.5, 0.0, k, str(k % 60)) for k in range(80)]
    rows += [(2, "q", k, "x" * k, 1.0 if k == 1 else 0.1, 1.0 if k == 1 else 0.1, 0.0, k, str(k)) for k in range(1, 30)]
    c = spark.createDataFrame(rows, "line int, query string, doc int, text string, lex double, cos double, penalty double, ord int, item_key string")
    size = lambda q, t: F.length(t).cast("double")
    got = R.rerank(c, size, 3).orderBy("line", "rank").collect()
    assert [r["doc"] for r in got if r["line"] == 1] == [60, 61, 62]  # hybrid ranks 61 to 63
    assert [r["doc"] for r in got if r["line"] == 2] == [1, 2, 3]  # sure: the scorer isn't asked
    first = spark.createDataFrame([(1, str(k)) for k in range(20)], "line int, item_key string")
    assert [r["doc"] for r in R.rerank(c, size, 3, first).where("line = 1").orderBy("rank").collect()] == [20, 21, 22]
    assert [r["doc"] for r in R.rerank(c, None, 3, first).where("line = 1").orderBy("rank").collect()] == [20, 21, 22]
