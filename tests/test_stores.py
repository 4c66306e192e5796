"""Snapshot tables under two writers, caches that ask a model once, the BM25 store against a rebuild, and the vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteloom.functions import text as T
from quoteloom.operators import ann
from quoteloom.operators import bestmatch as M
from quoteloom.operators import enrich as E
from quoteloom.operators import retrieval as V
from quoteloom.operators import scope as C
from quoteloom.sources import erp
from quoteloom.stores.answers import AnswerStore, call, prompts
from quoteloom.stores.bm25 import Bm25Store
from quoteloom.stores.caches import AttributeStore, EmbeddingStore, ExpansionStore, PairScoreStore, parse_paraphrases
from quoteloom.stores.snapshots import SnapshotTable


def rows(spark, ids, tag="x"):
    return spark.createDataFrame([(i, f"{tag}{i}") for i in ids], "k long, v string")


def test_two_writers(spark):
    table = SnapshotTable.fresh(spark, "k long, v string", ("k",))
    assert table.version() == 0 and table.read().count() == 0
    assert table.append(rows(spark, range(5), "a")) == 5
    seen = table.version()
    other = SnapshotTable(spark, table.folder, "k long, v string", ("k",))
    # both have looked at the same snapshot; the second commit finds its number taken
    assert table.append(rows(spark, range(3, 8), "b"), seen) == 3
    assert other.append(rows(spark, range(6, 10), "c"), seen) == 2
    assert other.append(rows(spark, [6, 7], "d"), seen) == 0
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert table.read().count() == len(got) == 10 and got[3] == "a3" and got[7] == "b7" and got[9] == "c9"
    assert table.read(seen).count() == 5  # an old reader's snapshot stays what it was
    assert table.append(rows(spark, range(10))) == 0 and table.append(rows(spark, [20, 20, 20])) == 1
    assert table.append(spark.createDataFrame([(None, "n")], "k long, v string")) == 0
    assert table.compact() and len(table.folders()) == 1 and table.read().count() == 11
    assert table.vacuum() > 0 and table.read().count() == 11


def test_a_commit_is_exclusive(spark):
    table = SnapshotTable.fresh(spark, "k long, v string", ("k",))
    name, n = table.write(rows(spark, range(4)))
    assert n == 4 and table.publish(1, [name]) and not table.publish(1, []) and table.read().count() == 4
    table.write(rows(spark, range(9)))  # a writer that dies here has changed nothing
    assert table.read().count() == 4


def counting():
    """A model that fails on texts it has seen; local, so that workers get it by value."""

    class Counting:
        def __init__(self):
            self.seen = set()

        def __call__(self, texts):
            assert not self.seen & set(texts)
            self.seen |= set(texts)
            return np.array([[float(len(t)), 1.0] for t in texts])

    return Counting


def test_vectors_are_encoded_once(spark):
    store = EmbeddingStore.fresh(spark, "counting", "1", counting())
    df = spark.createDataFrame([(1, "Ball Valve"), (2, "ball  valve!"), (3, None), (4, " "), (5, "pipe")], "id int, d string")
    out, n = store.vectors(df.where("id < 5"), F.col("d"))
    got = {r["id"]: r["vec"] for r in out.collect()}
    assert n == 1 and got[1] == got[2] == [10.0, 1.0] and got[3] is None and got[4] is None
    assert store.vectors(df, F.col("d"))[1] == 1 and store.vectors(df, F.col("d"))[1] == 0
    assert EmbeddingStore(store.table, "counting", "2", counting()).vectors(df, F.col("d"))[1] == 2  # another version asks anew
    assert store.vectors(df.where("false"), F.col("d"))[0].count() == 0


def test_pair_scores(spark):
    store = PairScoreStore.fresh(spark, "len", "1", lambda: lambda pairs: [float(len(a) + len(b)) for a, b in pairs])
    df = spark.createDataFrame([(1, "BALL-VALVE 1!", "pipe"), (2, 'ball valve 1"', "Pipe"), (3, "", "pipe"), (4, "x", None), (5, "x", "y")], "id int, query string, text string")
    out, n = store.scores(df.where("id < 5"))
    assert {r["id"]: r["score"] for r in out.collect()} == {1: 16.0, 2: 16.0, 3: 0.0, 4: 0.0} and n == 1
    assert store.scores(df)[1] == 1 and store.scores(df)[1] == 0


def test_attributes(spark):
    store = AttributeStore.fresh(spark)
    df = spark.createDataFrame([(1, "pipe 22 mm brass"), (2, "cable 240 V"), (3, None), (4, "cable 240 V")], "id int, d string")
    out, n = store.attributes(df, "d")
    got = {r["id"]: r["attributes"] for r in out.collect()}
    assert n == 2 and got[1]["size_mm"]["value"] == 22.0 and got[2] == got[4] and got[2]["voltage"]["value"] == 240.0 and got[3] is None
    assert store.attributes(df, "d")[1] == 0


def test_expansion(spark):
    def load():
        def ask(text, most):
            if text == "bad":
                raise OSError("down")
            return "Sure! " + '{"paraphrases": ["A", " a ", "", "b", "' + text.upper() + '", 7, "c", "d", "e", "f", "g", "h"]}'

        return ask

    lines = spark.createDataFrame([(1, " one "), (2, "bad"), (3, ""), (4, None), (5, "!!"), (6, "ONE")], "line int, description string")
    store = ExpansionStore.fresh(spark, "1", load)
    out, n = store.expand(lines, most=9)
    got = {r["line"]: r["queries"] for r in out.collect()}
    assert got == {1: ["one", "A", "b", "c", "d", "e", "f"], 2: ["bad"], 3: [], 4: [], 5: ["!!"], 6: ["ONE", "A", "b", "c", "d", "e", "f"]} and n == 2
    assert store.expand(lines)[1] == 0
    off, n = store.expand(lines, enabled=False)
    assert {r["line"]: r["queries"] for r in off.collect()}[1] == ["one"] and n == 0
    assert {r["line"]: r["queries"] for r in store.expand(lines, most=0)[0].collect()}[6] == ["ONE"]
    assert parse_paraphrases("none") == parse_paraphrases('{"paraphrases": 3}') == parse_paraphrases("{x}") == [] == parse_paraphrases(None)


def test_answers(spark):
    tried = []

    def ask(p):
        tried.append(p)
        if len(tried) < 3:
            raise ConnectionError("busy")
        return "fine"

    assert call(ask, "x", 4, 0.0) == ("fine", 3, "ConnectionError: busy")
    assert call(lambda p: 1 / 0, "x", 2, 0.0)[:2] == (None, 2)

    def load():
        seen = set()

        def one(p):
            if p == "never":
                raise TimeoutError
            assert p not in seen  # an answer is asked for once
            seen.add(p)
            return p.upper()

        return one

    store = AnswerStore.fresh(spark, "upper", "1", load, tries=2, pause=0.0)
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "never"), (4, "a")], "batch int, prompt string")
    out, n = store.answers(asked)
    got = {r["batch"]: (r["answer"], r["chars_in"]) for r in out.collect()}
    assert got == {1: ("A", 1), 2: ("B", 1), 3: (None, None), 4: ("A", 1)} and n == 2
    assert store.answers(asked.where("batch <> 3"))[1] == 0


def test_prompts_hold_every_line_once(spark):
    lines = spark.createDataFrame([(i, f"X{i}", f"thing {i}") for i in range(45)], "line int, item_no string, description string")
    cands = spark.createDataFrame([(i, r, f"Y{i}-{r}", f"thing {i}", 1.0) for i in range(44) for r in (1, 2)], "line int, rank int, item_no string, item_description string, unit_cost double")
    got = [r["prompt"] for r in prompts(lines, cands, per=10).collect()]
    assert 1 < len(got) <= 5
    for i in range(45):
        assert sum(f'"X{i}"' in p for p in got) == 1
    assert sum(p.count("Y7-1") for p in got) == 1


def test_bm25_store_is_a_rebuild(spark):
    docs = spark.createDataFrame([(i, " ".join(["valve", "pipe", f"w{i % 7}", f"u{i}"][: 1 + i % 4]) if i % 9 else None) for i in range(60)], "doc long, text string")
    store = Bm25Store.fresh(spark)
    assert store.ensure(docs.where("doc < 50")) == (50, 0)
    changed = docs.where("doc <> 3").withColumn("text", F.when(F.col("doc") % 10 == 0, F.lit("valve other")).otherwise(F.col("text")))
    assert store.ensure(changed) == (15, 6)  # ten new ones and five changed; five and the deleted one go
    assert store.ensure(changed) == (0, 0)
    queries = spark.createDataFrame([(1, ["valve", "w3"]), (2, ["other", "pipe", "pipe"]), (3, [])], "q int, terms array<string>")
    rebuilt = V.bm25_index(changed, T.tokens(F.col("text")))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(V.bm25_topk(rebuilt, queries, 10))
    assert key(V.bm25_topk(store.get(), queries, 10)) == want
    assert store.compact() and key(V.bm25_topk(store.get(), queries, 10)) == want
    assert store.ensure(docs.where("false"))[1] == 59 and store.get()["lengths"].count() == 0


def test_bm25_topk_matches_all_scores(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * k) % 11}" for k in range(1, 2 + i % 6))) for i in range(40)] + [(90, None), (91, "")], "doc long, text string")
    index = V.bm25_index(docs, T.tokens(F.col("text")))
    queries = spark.createDataFrame([(1, ["t1", "t2", "t2"]), (2, ["t5"]), (3, ["zz"]), (4, [])], "q int, terms array<string>")
    every = {(r["q"], r["doc"]): r["score"] for r in V.bm25_scores(index, queries).collect()}
    got = V.bm25_topk(index, queries, 12, block=2).collect()
    for q in (1, 2, 3, 4):
        want = sorted(((-every.get((q, d), 0.0), d) for d in [*range(40), 90, 91]))[:12]
        assert [(r["doc"], round(r["score"], 5)) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [(d, round(-s, 5)) for s, d in want]


def test_ann_recall_and_exact_way(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16)) * 3
    x = centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16))
    x[:500] = x[0]  # a third of all rows is one vector
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(9999, None)], "doc long, vec array<double>").repartition(4)
    q = v.where("doc % 50 = 0").withColumnRenamed("doc", "q")
    index = ann.build(v, lists=20, k=10)
    exact = V.knn(q.where("vec IS NOT NULL"), v, 10)
    assert index.rows.count() == 1500 and index.recall >= 0.95
    assert ann.recall(ann.search(index, q, 10), exact) >= 0.9
    whole = ann.search(index, q, 10, probes=20)
    assert sorted(map(tuple, whole.select("q", "doc", "rank").collect())) == sorted(map(tuple, exact.select("q", "doc", "rank").collect()))
    small, ann.CELL, ann.ASKED = (ann.CELL, ann.ASKED), 100, 7  # a list over many cells and groups
    try:
        assert sorted(map(tuple, ann.search(index, q, 10, probes=20).select("q", "doc", "rank").collect())) == sorted(map(tuple, exact.select("q", "doc", "rank").collect()))
    finally:
        ann.CELL, ann.ASKED = small
    assert ann.search(ann.build(v.where("false")), q, 10).count() == 0


@pytest.mark.parametrize("score", ["tokens", "sequence"])
def test_best_match_is_that_of_all_pairs(spark, score):
    words = "brass steel ball gate valve pipe elbow 22mm 15mm type rubber hose black pump motor".split()
    rng = np.random.default_rng(6)
    pick = lambda n: " ".join(rng.choice(words, n))
    texts = [pick(rng.integers(1, 7)) for _ in range(120)] + ["", "x", "zinc", "brass ball valve"]
    work = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (501, "brass ball valve")], "doc long, item_description string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([pick(rng.integers(1, 6)) for _ in range(40)] + ["", "zinc", "unlike anything", "brass ball valve", None])], "line long, description string")
    f = T.token_score if score == "tokens" else T.similarity
    for floor in (0.06, 0.22, 0.5):
        pairs = asked.select("description").distinct().where("description IS NOT NULL").crossJoin(work.groupBy("item_description").agg(F.min("doc").alias("doc")).where("item_description IS NOT NULL"))
        pairs = pairs.withColumn("sim", F.round(f(F.col("description"), F.col("item_description")), 6)).where(F.col("sim") >= floor)
        want = pairs.groupBy("description").agg(F.max(F.struct("sim", (-F.col("doc")).alias("k"))).alias("b")).select("description", (-F.col("b.k")).alias("doc"), "b.sim")
        found = M.anywhere(asked, work, floor, f)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


ROW = "doc long, item_no string, item_description string, unit_cost double, unit string, po_number string, po_order_date date, vendor string, project_name string"


def test_cascade_and_fill(spark):
    import datetime

    day = datetime.date(2024, 5, 1)
    full = lambda doc, item, text, cost: (doc, item, text, cost, "ea", f"PO{doc}", day + datetime.timedelta(doc), f"V{doc}", "S")
    work = spark.createDataFrame([full(1, "A", "brass ball valve", None), full(2, "A", "brass gate valve", 7.0), full(3, "B", "rubber hose black", 9.0), full(4, "C", "zinc plate thin", 5.0), full(5, "D", "lonely", None)], ROW)
    asked = spark.createDataFrame([(1, "A", "brass ball valve"), (2, "A", None), (3, "Z", "rubber hose"), (4, None, "zinc something quite different here"), (5, "D", "rubber hose black"), (6, None, "nothing alike"), (7, "b", None)], "line int, ref_item string, q string")
    got = {r["line"]: (r["doc"], r["step"]) for r in E.pick_row(asked, work, T.token_score).collect()}
    # the row meant for 1 and 2 has no price, so the item's first priced row counts; D has none, so the text does
    assert got == {1: (2, "same_item"), 2: (2, "same_item"), 3: (3, "resolved"), 4: (4, got[4][1]), 5: (3, "description"), 7: (3, "resolved")}
    assert {r["line"]: r["row"]["po_number"] for r in E.reference_row(asked, work, T.token_score).collect()}[1] == "PO1"  # priced or not
    assert {r["line"]: r["doc"] for r in E.first_priced(asked, work).collect()} == {1: 2, 2: 2, 7: 3}
    rows_ = spark.createDataFrame([(1, "rubber hose black", "B", "model's text", 9.5, datetime.date(1999, 1, 1), None), (2, "unknown", None, None, None, None, None)], "line int, description string, ref_item_no string, ref_item_description string, ref_unit_cost double, ref_po_order_date date, confidence double")
    out = {r["line"]: r for r in E.fill_from_row(rows_, work, T.token_score).collect()}
    assert out[1]["ref_po_order_date"] == day + datetime.timedelta(3) and out[1]["ref_item_description"] == "rubber hose black" and out[1]["confidence"] > 80
    assert out[2]["confidence"] is None and out[2]["ref_po_order_date"] is None


def test_scope(spark):
    embed = lambda t: F.array(*[t.rlike(p).cast("double") for p in ("tile|floor", "door", "pipe", "pump")])
    scope = spark.createDataFrame([(1, "ceramic floor tile"), (2, " "), (3, "wooden door"), (4, "pvc pipe")], "scope_idx long, scope_text string")
    lines = spark.createDataFrame([(1, "floor tile 60x60"), (2, ""), (3, "marble tile"), (4, "quartz countertop"), (5, None), (6, "pvc door")], "line int, description string")
    got = {r["line"]: r for r in C.match_scope(lines, scope, embed).collect()}
    assert (got[1]["in_scope"], got[1]["matched_scope_text"], got[1]["method"]) == (True, "ceramic floor tile", "hybrid")
    assert got[2]["method"] == got[5]["method"] == "empty_description" and got[2]["confidence"] == 0.0
    assert got[3]["matched_scope_text"] == "ceramic floor tile" and not got[4]["in_scope"]
    assert got[6]["matched_scope_text"] == "wooden door"
    assert {r["method"] for r in C.match_scope(lines, scope.where("scope_idx = 2"), embed).collect()} == {"empty_scope"}
    assert sorted(map(tuple, C.match_scope(lines, scope, embed, block=1).collect())) == sorted(map(tuple, got.values()))


def test_lines_are_parsed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("Material,Item Description,Net Price\n1,pipe,SAR 5\n2,valve,\n")
    (folder / "b.csv").write_text("Material,Item Description,Net Price\n3,hose,7\n")
    got, known = erp.parsed_lines(spark, f"{folder}/*.csv", str(tmp_path / "cache"))
    assert not known and sorted((r["item_no"], r["unit_cost"]) for r in got.collect()) == [("1", "SAR 5"), ("2", None), ("3", "7")]
    (folder / "a.csv").rename(folder / "z.csv")
    assert erp.parsed_lines(spark, f"{folder}/*.csv", str(tmp_path / "cache"))[1]
    (folder / "b.csv").write_text("Material,Item Description,Net Price\n4,hose,7\n")
    again, known = erp.parsed_lines(spark, f"{folder}/*.csv", str(tmp_path / "cache"))
    assert not known and again.count() == 3


def test_keys_are_of_folded_texts(spark):
    from quoteloom.operators import canonical

    wide = "ＢＡＬＬ　Ｖａｌｖｅ ２２ｍｍ ½"
    lines = spark.createDataFrame([("A", wide), ("B", "ball valve 22mm 1\u20442"), ("C", None)], "item_no string, item_description string")
    assert [tuple(r) for r in canonical.registry(lines).collect()] == [("ball valve 22mm 1 2", ["A", "B"])]
    store = EmbeddingStore.fresh(spark, "counting", "folded", counting())
    assert store.vectors(lines, F.col("item_description"))[1] == 1
