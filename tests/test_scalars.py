from pyspark.sql import functions as F

from quoteloom.functions import attributes as A
from quoteloom.functions import responses
from quoteloom.functions import scalars as S
from quoteloom.functions import text as T


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_keys(spark):
    assert column(spark, ["12.0", " ab​ 1 ", None, "nan", "ａｂ"], lambda c: S.item_key(c, fold=True)) == ["12", "AB 1", "", "", "AB"]
    assert column(spark, ["CO", "Acme Trading Co.", "Beta W.L.L", "x est."], S.vendor_key_local) == ["CO", "ACMETRADING", "BETA", "X"]


def test_numbers(spark):
    assert column(spark, ["1,234", "1,234.5", "x", None], S.clean_numeric) == [1.234, 1234.5, None, None]
    assert column(spark, ["1,234", "-3"], S.nullable_float) == [1234.0, -3.0]
    assert column(spark, ["SAR 1,234.50", "12 pcs at 3", "NaN"], S.unit_cost_scalar) == [1234.5, 12.0, None]


def test_dates(spark):
    assert column(spark, ["45000", "12", "2001-02-03", "03/02/2001", "?"], S.po_date_iso) == ["2023-03-15", None, "2001-02-03", "2001-02-03", None]


def test_blend(spark):
    rows = spark.createDataFrame([(0, 80.0, 60.0), (1, 50.0, None), (2, None, 90.0), (3, None, None), (4, 120.0, 110.0)], "i int, a double, b double")
    assert [r[0] for r in rows.orderBy("i").select(S.blend_confidence(F.col("a"), F.col("b"))).collect()] == [71.0, 50.0, 90.0, None, 100.0]


def test_tokens(spark):
    a, b, c, d = column(spark, ["copper press elbow 22 mm type b", "PD-100039641 RENTAL CHARGES IFAS", "buildings", "ID NO 12345"], T.tokens)
    assert "22mm" in a and "22" not in a
    assert any(t.startswith("pd100039641") for t in b) and "pd" not in b
    assert c == ["building"] and {"id", "no"} <= set(d)


def test_units_end_as_in_sql(spark):
    texts = ["1 inßlichver", "5 mètres", "3 inner 4 kg_ 6 kg-b 7 kg"]
    assert column(spark, texts, T.tokens) == [["1inßlichver"], ["5mètres"], ["3", "inner", "4", "kg_", "6kgb", "7kg"]]


def test_similarity(spark):
    df = spark.createDataFrame([("steel pipe 10 mm", "steel pipe 10mm"), ("a", "steel"), ("office copier toner", "carbon steel pipe sch40")], "q string, r string")
    same, short, far = [r[0] for r in df.select(T.similarity(F.col("q"), F.col("r"))).collect()]
    assert same == 1.0 and short == 0.0 and far < 0.6


def test_canonical(spark):
    assert column(spark, ["Steel-Pipe (10mm)", None], T.canonical) == ["steel pipe 10mm", ""]
    assert column(spark, ["discs 10mm boxes cabinets"], T.canonical_loose) == ["disk 10 mm box cabinet"]


def test_attributes():
    a = A.parse('dia 22 mm copper elbow 1-1/2 in pack of 12 240 volt 5 ltr')
    assert a["size_mm"] == {"value": 22.0, "conf": 1.0} and a["size_inch"] == {"value": 1.5, "conf": 1.0}
    assert a["pack_size"]["value"] == 12 and a["voltage"]["value"] == 240 and a["capacity_l"]["value"] == 5 and a["material"]["value"] == "copper"
    assert A.parse(None) == dict.fromkeys(A.NAMES)


def test_filter(spark):
    df = spark.createDataFrame([("pipe 10 mm", "pipe 20 mm"), ("pipe 10 mm", "pipe 10.4 mm copper"), ("copper pipe 10 mm", "pvc pipe"), ("lamp 220 v", "lamp 240 v")], "q string, c string")
    got = df.select(A.extract("q").alias("q"), A.extract("c").alias("c")).select(A.decide(F.col("q"), F.col("c")).alias("f")).select("f.*").collect()
    assert [(r.keep, r.penalty) for r in got] == [(False, 0.0), (True, 0.0), (True, 0.5), (False, 0.0)]


def test_answers():
    text = 'Sure:\n```json\n{"result": {"matches": [{"itemNo": "7", "best_match": {"unitCost": "SAR 5"}, "matched": false}]}}\n```'
    (m,) = responses.find_matches(responses.loads_loose(text))
    assert responses._pick(m, responses.FIELDS["unit_cost"]) == "SAR 5" and responses._pick(m, responses.FIELDS["matched"]) == "false"
    assert responses.find_matches(responses.loads_loose("no json")) == []


def test_messy_literals(spark):
    """Spellings that the tables don't have."""
    assert column(spark, ["12.0", " 12.00 ", "ab  1", "NaN", None, "0012", "12.5", "x 1.0", "7.000"], S.item_key) == ["12", "12", "AB 1", "", "", "0012", "12.5", "X 1.0", "7"]
    assert column(spark, ["12.0", "12.0000000001", "12.5", " po  7 ", "007", None], S.po_key) == ["12", "12", "12.5", "PO 7", "007", ""]
    assert column(spark, ["P/H", "p/h.", "ea.", " Nos ", "m 2", None, "K.G."], S.uom_key) == ["PH", "PH", "EA", "NOS", "M2", "", "KG"]
    assert column(spark, ["ACME TRADING COMPANY", "acme llc", "Gamma Corp Inc", "  delta  est. ", None, "Omega & Sons Ltd", "a-b 12"], S.vendor_key_local) == ["ACMETRADING", "ACME", "GAMMACORP", "DELTA", "", "OMEGASONS", "AB12"]
    assert column(spark, ["non", "N/A", "na", "x", "--", " pump ", "TBD", None, "valve 10 mm"], S.placeholder_to_empty) == ["", "", "", "", "", "pump", "", "", "valve 10 mm"]
    assert column(spark, ["mbl", "IFAS ", "msb", "other", None], S.company_tab) == ["MBL", "IFAS", "MSB", "MBL", "MBL"]
    assert column(spark, ["0.5", "1", "87", "101", "-1", None, "0"], lambda c: S.confidence_pct(c.try_cast("double"))) == [50.0, 100.0, 87.0, None, None, None, 0.0]
    assert column(spark, ["True", "1", "YES", "false", "0", "no", "maybe", None], S.matched_flag) == [True, True, True, False, False, False, None, None]
    assert column(spark, ['{"a": 1}', 'text {"b": 2} text', '```json\n{"c": 3}\n```', "none", None, "[1, 2]"], S.json_loose) == ['{"a": 1}', '{"b": 2}', '{"c": 3}', None, None, None]
    assert column(spark, ["45000", "12", "2001/02/03", "?"], lambda c: F.date_format(S.po_date_cell(c), "yyyy-MM-dd")) == [None, None, "2001-02-03", None]  # bare numbers in text are no dates
