"""All queries of the engine over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attributes as A
from ..functions import responses
from ..functions import scalars as S
from ..functions import text as T
from ..operators import benchmark as B
from ..operators import canonical as C
from ..operators import crossmatch as X
from ..operators import rerank as R
from ..operators import retrieval as V
from ..operators import workframe as W
from ..session import cut, spread
from ..sources import erp
from ..sources.erp import ERP_SQL
from ..stores.snapshots import SnapshotTable
from ..streaming import index_delta as index_stream

AS_OF, CUTOFF = "2003-06-01", "2001-06-01"
#: Lines before this day are in the index of index_delta and index_status.
INDEXED_BEFORE = "1995-03-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def lines(spark: SparkSession, d: str, by_part: bool = False) -> DataFrame:
    return B.keyed(erp.erp_lines(spark, d, by_part))


_TIE = "po_number, line_no, item_no, vendor, qty, unit_cost"
_LINE = "item_key, item_no, item_description, unit_cost, unit, po_number, po_order_date, vendor, qty, project_name"
_COLS = _LINE.split(", ")


def _first_sql(where: str, order: str, cte: str = "") -> str:
    return f"WITH {ERP_SQL}{cte} SELECT {_LINE} FROM erp WHERE {where} QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY {order}, {_TIE}) = 1"


# --- benchmarks


@query(_first_sql("true", "po_order_date DESC NULLS LAST"))
def benchmark_latest_by_item(spark, d):
    return B.latest(lines(spark, d, by_part=True)).select(*_COLS)


@query(_first_sql("unit_cost IS NOT NULL", "unit_cost, po_order_date DESC NULLS LAST"))
def benchmark_lowest_by_item(spark, d):
    return B.lowest(lines(spark, d, by_part=True)).select(*_COLS)


@query(_first_sql(f"unit_cost IS NOT NULL AND po_order_date < DATE '{CUTOFF}'", "po_order_date DESC"))
def benchmark_before_window(spark, d):
    return B.before_window(lines(spark, d, by_part=True), CUTOFF).select(*_COLS)


_WINDOW = f"CASE WHEN po_order_date >= DATE '{CUTOFF}' THEN 0 ELSE 1 END, CASE WHEN po_order_date >= DATE '{CUTOFF}' THEN unit_cost END NULLS LAST, po_order_date DESC"


@query(_first_sql("unit_cost IS NOT NULL AND po_order_date IS NOT NULL", _WINDOW))
def benchmark_window_fallback(spark, d):
    return B.window_fallback(lines(spark, d, by_part=True), CUTOFF).select(*_COLS)


def _vendor(spark, d) -> str:
    """The vendor of the smallest key: there at every scale."""
    return spark.read.parquet(f"{d}/supplier.parquet").agg(F.min(F.struct("s_suppkey", "s_name")).alias("x")).first()["x"]["s_name"]


_VENDOR = "(SELECT s_name FROM supplier ORDER BY s_suppkey, s_name LIMIT 1)"


@query(_first_sql(f"unit_cost IS NOT NULL AND po_order_date IS NOT NULL AND upper(trim(vendor)) <> upper(trim({_VENDOR}))", _WINDOW))
def benchmark_other_vendor(spark, d):
    return B.window_fallback(B.other_vendor(lines(spark, d, by_part=True), _vendor(spark, d)), CUTOFF).select(*_COLS)


@query(_first_sql(f"unit_cost IS NOT NULL AND po_order_date IS NOT NULL AND upper(trim(vendor)) = upper(trim({_VENDOR}))", _WINDOW))
def benchmark_same_vendor(spark, d):
    return B.window_fallback(B.same_vendor(lines(spark, d), _vendor(spark, d)), CUTOFF).select(*_COLS)


def items(spark, d) -> DataFrame:
    """Every part as an input item; every fifth asks without a price, every seventh without a description."""
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    return p.select(k.alias("pos"), F.concat(F.lit(" "), k.cast("string"), F.lit(".0 ")).alias("item_no"), F.when(k % 7 == 0, "").otherwise(F.col("p_name")).alias("description"), F.lit("p.h").alias("unit"), F.when(k % 3 > 0, (k % 10).cast("double")).alias("qty"), F.when(k % 5 > 0, F.col("p_retailprice")).alias("new_unit_cost"))


_ITEMS = """items AS (
  SELECT p_partkey AS pos, ' ' || CAST(p_partkey AS VARCHAR) || '.0 ' AS item_no, CAST(p_partkey AS VARCHAR) AS item_key,
         CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS description, 'p.h' AS unit,
         CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 10 AS DOUBLE) END AS qty,
         CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS new_unit_cost FROM part)"""


def _bench(name: str, where: str) -> str:
    return f"{name} AS (SELECT * FROM erp WHERE unit_cost IS NOT NULL AND po_order_date IS NOT NULL AND trim(po_number) <> '1' AND {where} QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY {_WINDOW}, {_TIE}) = 1)"


def _day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


@query(
    f"""WITH {ERP_SQL}, {_ITEMS}, {_bench("a", "true")}, {_bench("l", f"upper(trim(vendor)) <> upper(trim({_VENDOR}))")}, {_bench("o", f"upper(trim(vendor)) = upper(trim({_VENDOR}))")},
n AS (SELECT item_key, arg_min(item_description, (po_number, line_no, item_description)) AS any_description FROM erp WHERE trim(po_number) <> '1' AND trim(item_description) <> '' GROUP BY item_key)
SELECT i.pos AS id, i.item_no, i.item_key, a.po_number AS previous_po_number, '1' AS new_po_number, {_VENDOR} AS vendor_given,
  coalesce(nullif(trim(i.description), ''), nullif(trim(a.item_description), ''), nullif(trim(n.any_description), ''), 'non') AS description,
  i.unit, a.unit AS hist_unit_last_po,
  CASE WHEN a.unit IS NULL THEN false ELSE 'PH' <> CASE WHEN replace(upper(a.unit), '.', '') = 'P/H' THEN 'PH' ELSE replace(upper(a.unit), '.', '') END END AS unit_mismatch,
  l.unit_cost AS lowest_hist_unit_cost, o.unit_cost AS same_vendor_latest_hist_unit_cost, o.vendor AS same_vendor_benchmark_vendor,
  {_day("o.po_order_date")} AS same_vendor_benchmark_po_date, o.po_number AS same_vendor_benchmark_po_number, o.project_name AS same_vendor_benchmark_site_name,
  o.unit AS same_vendor_hist_unit, l.vendor AS lowest_benchmark_vendor, {_day("l.po_order_date")} AS lowest_benchmark_po_date,
  l.po_number AS lowest_benchmark_po_number, l.unit AS lowest_benchmark_hist_unit, l.project_name AS lowest_benchmark_site_name,
  coalesce(i.new_unit_cost, l.unit_cost) AS new_unit_cost, coalesce(i.qty, 1.0) AS qty, l.unit_cost * coalesce(i.qty, 1.0) AS benchmark_line_cost,
  coalesce(i.new_unit_cost, l.unit_cost) * coalesce(i.qty, 1.0) AS new_line_cost,
  (coalesce(i.new_unit_cost, l.unit_cost) - l.unit_cost) * coalesce(i.qty, 1.0) AS difference_sar,
  CASE WHEN l.unit_cost <> 0 THEN (coalesce(i.new_unit_cost, l.unit_cost) - l.unit_cost) / l.unit_cost * 100 END AS pct_change,
  a.vendor AS vendor_last, {_day("a.po_order_date")} AS last_po_date, a.unit_cost IS NOT NULL AS has_history
FROM items i LEFT JOIN a USING (item_key) LEFT JOIN l USING (item_key) LEFT JOIN o USING (item_key) LEFT JOIN n USING (item_key)"""
)
def compare_items(spark, d):
    return B.compare(lines(spark, d), items(spark, d), "1", _vendor(spark, d), CUTOFF)


@query(
    f"""WITH {ERP_SQL}, {_ITEMS}, b AS (SELECT * FROM erp WHERE unit_cost IS NOT NULL AND po_order_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY {_WINDOW}, {_TIE}) = 1)
SELECT i.item_key, i.item_no, coalesce(nullif(trim(i.description), ''), nullif(trim(b.item_description), ''), 'non') AS description, b.unit_cost AS reference_unit_cost,
  b.unit AS hist_unit, b.po_number, {_day("b.po_order_date")} AS po_date, b.vendor, b.project_name AS site_name, b.unit_cost IS NOT NULL AS has_history
FROM items i LEFT JOIN b USING (item_key)"""
)
def item_reference(spark, d):
    return B.item_reference(lines(spark, d, by_part=True), items(spark, d), CUTOFF)


@query(f"WITH {ERP_SQL} SELECT row_number() OVER (ORDER BY po_order_date DESC NULLS LAST, po_number DESC NULLS LAST, {_TIE}) AS pos, item_key, po_number, {_day('po_order_date')} AS po_date, vendor, unit_cost, unit, qty, project_name FROM erp WHERE item_key = '1'")
def item_po_history(spark, d):
    return B.item_history(lines(spark, d), "1.0")


@query(f"WITH {ERP_SQL} SELECT row_number() OVER (ORDER BY po_order_date DESC NULLS LAST, item_no NULLS LAST, {_TIE}) AS pos, po_number, item_no, item_description, CAST(CAST(qty AS BIGINT) AS VARCHAR) AS qty, unit, unit_cost, unit_cost * qty AS line_cost, {_day('po_order_date')} AS po_date, vendor, project_name FROM erp WHERE po_number = (SELECT CAST(min(l_orderkey) AS VARCHAR) FROM lineitem)")
def po_history_lines(spark, d):
    po = spark.read.parquet(f"{d}/lineitem.parquet").agg(F.min("l_orderkey")).first()[0]
    return B.order_lines(lines(spark, d), f"{po}")


def _mode(c: str) -> str:
    return f"(SELECT po_number, {c}, count(*) AS n FROM erp GROUP BY po_number, {c} QUALIFY row_number() OVER (PARTITION BY po_number ORDER BY count(*) DESC, min((line_no, item_no, qty)), {c}) = 1)"


@query(f"WITH {ERP_SQL}, b AS (SELECT po_number, min(po_order_date) AS po_date, count(*) AS n_lines FROM erp GROUP BY po_number), v AS {_mode('vendor')}, p AS {_mode('project_name')} SELECT b.po_number, b.po_date, b.n_lines, v.vendor AS dominant_vendor, v.n AS n_vendor, p.project_name AS dominant_project_name, p.n AS n_project_name FROM b JOIN v USING (po_number) JOIN p USING (po_number)")
def po_prefill_mode(spark, d):
    return B.prefill(lines(spark, d))


@query(f"WITH {ERP_SQL} SELECT item_key, count(*) AS n FROM erp WHERE trim(po_number) <> '7' GROUP BY item_key")
def po_exclusion(spark, d):
    return B.exclude_po(lines(spark, d), " 7 ").groupBy("item_key").agg(F.count("*").alias("n"))


@query("SELECT item_no, pos FROM (SELECT CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '.0' ELSE '' END AS item_no, l_orderkey * 10 + l_linenumber AS pos, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY pos, item_no) = 1")
def dedupe_input_items(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.select(F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".0").otherwise("")).alias("item_no"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"), F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".0").otherwise("")).alias("i")).alias("pos"))
    return B.dedupe_items(rows).select("item_no", F.col("pos.p").alias("pos"))


# --- scalars, over texts of the tables


def words(spark, d) -> DataFrame:
    """The distinct words of all documents: numbers, codes, addresses and prose."""
    w = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", r"[ \n]+")).alias("raw"))
    return w.select(F.replace("raw", F.lit("ß"), F.lit("ss")).alias("raw")).distinct()  # the engines' capitals of ß differ


def _words_sql(select: str) -> str:
    return f"SELECT raw, {select} FROM (SELECT DISTINCT replace(w, 'ß', 'ss') AS raw FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents))"


_SQ = r"trim(regexp_replace(coalesce(CAST(raw AS VARCHAR), ''), '\s+', ' ', 'g'))"


@query(_words_sql(rf"upper(CASE WHEN lower({_SQ}) = 'nan' THEN '' ELSE regexp_replace({_SQ}, '^(\d+)\.0+$', '\1') END) AS item_key"))
def normalize_item_key(spark, d):
    return words(spark, d).select("raw", S.item_key(F.col("raw")).alias("item_key"))


@query(_words_sql(rf"upper(CASE WHEN {_SQ} LIKE '%.%' AND try_cast({_SQ} AS DOUBLE) IS NOT NULL AND abs(try_cast({_SQ} AS DOUBLE) - round(try_cast({_SQ} AS DOUBLE))) < 1e-9 THEN CAST(CAST(round(try_cast({_SQ} AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE {_SQ} END) AS po_key"))
def normalize_po_key(spark, d):
    return words(spark, d).select("raw", S.po_key(F.col("raw")).alias("po_key"))


_U = "replace(replace(upper(trim(coalesce(raw, ''))), '.', ''), ' ', '')"


@query(_words_sql(f"CASE WHEN {_U} = 'P/H' THEN 'PH' ELSE {_U} END AS uom, ({_U} <> '' AND CASE WHEN {_U} = 'P/H' THEN 'PH' ELSE {_U} END <> 'PH') AS mismatch"))
def normalize_uom(spark, d):
    return words(spark, d).select("raw", S.uom_key(F.col("raw")).alias("uom"), S.uom_mismatch(F.col("raw"), F.lit("p/h")).alias("mismatch"))


@query("SELECT s_suppkey, upper(trim(s_name)) AS vendor_key FROM supplier")
def vendor_key(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", S.vendor_key(F.col("s_name")).alias("vendor_key"))


def _strip_sql() -> str:
    t = "upper(trim(coalesce(raw, '')))"
    for s in S.VENDOR_SUFFIXES:
        t = f"trim(regexp_replace({t}, '{s.replace('.', chr(92) + '.')}$', ''))"
    return f"regexp_replace({t}, '[^A-Z0-9]', '', 'g')"


_ENDINGS = ("", *S.VENDOR_SUFFIXES, " Corp Inc", " est. ")
_WORDS_RAW = r"SELECT DISTINCT replace(w, 'ß', 'ss') AS raw FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS w FROM documents)"
_NAMED = f"SELECT raw, {_strip_sql()} AS vendor_key FROM ({_WORDS_RAW} UNION ALL SELECT s_name || e AS raw FROM supplier, (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in _ENDINGS)}) x(e))"


@query(_NAMED)
def vendor_key_local(spark, d):
    """Words, which have no space and so no suffix, and every supplier's name under each company suffix."""
    named = spark.read.parquet(f"{d}/supplier.parquet").select(F.explode(F.transform(F.array(*[F.lit(e) for e in _ENDINGS]), lambda e: F.concat("s_name", e))).alias("raw"))
    return words(spark, d).unionByName(named).select("raw", S.vendor_key_local(F.col("raw")).alias("vendor_key"))


_KEPT = r"regexp_replace(coalesce(raw, ''), '[^0-9,.\-]', '', 'g')"
_PLAIN = r"CASE WHEN regexp_full_match({0}, '[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?') THEN try_cast({0} AS DOUBLE) END"
_CLEAN = _PLAIN.format(f"(CASE WHEN {_KEPT} LIKE '%,%' AND {_KEPT} LIKE '%.%' THEN replace({_KEPT}, ',', '') ELSE replace({_KEPT}, ',', '.') END)")


@query(_words_sql(f"{_CLEAN} AS number"))
def clean_numeric(spark, d):
    return words(spark, d).select("raw", S.clean_numeric(F.col("raw")).alias("number"))


@query(_words_sql(_PLAIN.format(f"replace({_KEPT}, ',', '')") + " AS number"))
def nullable_float(spark, d):
    return words(spark, d).select("raw", S.nullable_float(F.col("raw")).alias("number"))


_BARE = r"regexp_replace(coalesce(raw, ''), '(?i)SAR|USD|EUR|[,\s]', '', 'g')"
_ONE = r"nullif(regexp_extract(replace(coalesce(raw, ''), ',', ''), '(-?\d+(?:\.\d+)?)', 1), '')"


@query(_words_sql(f"coalesce({_PLAIN.format(_BARE)}, {_PLAIN.format(_ONE)}, {_CLEAN}) AS number"))
def unit_cost_scalar(spark, d):
    return words(spark, d).select("raw", S.unit_cost_scalar(F.col("raw")).alias("number"))


def _raw_dates(spark, d) -> DataFrame:
    """Order days as they are written, as Excel serials, and as numbers that are none."""
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey") % 6
    day, serial = F.col("o_orderdate").cast("date"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "dd/MM/yyyy")).when(k == 3, serial.cast("string")).when(k == 4, F.concat(serial.cast("string"), F.lit(".7"))).otherwise(F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", raw.alias("raw"))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) WHEN 4 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) || '.7' ELSE CAST(o_orderkey AS VARCHAR) END AS raw FROM orders"


_DAY_RULE = "strftime(CASE WHEN try_cast(raw AS DOUBLE) IS NOT NULL THEN CASE WHEN try_cast(raw AS DOUBLE) BETWEEN 29500 AND 65000 THEN DATE '1899-12-30' + CAST(floor(try_cast(raw AS DOUBLE)) AS INTEGER) END ELSE coalesce(CAST(try_strptime(raw, '%Y-%m-%d') AS DATE), CAST(try_strptime(raw, '%Y/%m/%d') AS DATE), CAST(try_strptime(raw, '%d/%m/%Y') AS DATE)) END, '%Y-%m-%d') AS day"


@query(f"SELECT o_orderkey, {_DAY_RULE} FROM ({_DATES})")
def po_date_iso(spark, d):
    return _raw_dates(spark, d).select("o_orderkey", S.po_date_iso(F.col("raw")).alias("day"))


@query("SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(30000 + o_orderkey % 30000 AS INTEGER), '%Y-%m-%d') AS day FROM orders")
def excel_serial_date(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", S.po_date_iso((F.lit(30000) + F.col("o_orderkey") % 30000).cast("string")).alias("day"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS text FROM lineitem")
def fmt_cell_num(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", S.fmt_cell_num(F.col("l_quantity")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 80000 THEN substring(text, 1, 80000) || ' [cut]' ELSE text END AS text FROM documents")
def text_cap(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.cap_text(F.col("text"), 80_000, " [cut]").alias("text"))


@query(_words_sql("CASE WHEN length(trim(coalesce(raw, ''))) < 3 OR lower(trim(coalesce(raw, ''))) IN ('non', 'n/a', 'na', 'none', 'tbd', '-', '--', '.', '…') THEN '' ELSE trim(raw) END AS description"))
def placeholder_desc(spark, d):
    return words(spark, d).select("raw", S.placeholder_to_empty(F.col("raw")).alias("description"))


_TAB_RAW = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' mbl' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'Ifas ' ELSE 'MSB' END || CASE WHEN c_custkey % 8 = 7 THEN ' ' || c_name ELSE '' END AS raw FROM customer"


_TAB_RULE = "CASE WHEN upper(trim(coalesce(raw, ''))) IN ('IFAS', 'MBL', 'MSB') THEN upper(trim(raw)) ELSE 'MBL' END AS tab, trim(regexp_replace(lower(trim(coalesce(raw, 'X Y & Z'))), '[^a-z0-9]+', '_', 'g'), '_') AS slug"


@query(f"SELECT c_custkey, {_TAB_RULE} FROM ({_TAB_RAW})")
def company_tab(spark, d):
    c, k = spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey") % 4
    tab = F.when(k == 0, " mbl").when(k == 1, F.lower("c_mktsegment")).when(k == 2, "Ifas ").otherwise("MSB")
    m = c.select("c_custkey", F.concat(tab, F.when(F.col("c_custkey") % 8 == 7, F.concat(F.lit(" "), "c_name")).otherwise("")).alias("raw"))
    return m.select("c_custkey", S.company_tab(F.col("raw")).alias("tab"), S.company_slug(F.coalesce("raw", F.lit("X Y & Z"))).alias("slug"))


def _line_texts(spark, d) -> DataFrame:
    """Discounts as percentages, quantities, these below zero, and order keys, as text."""
    k, whole = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int").cast("string")
    raw = F.when(k == 0, F.round(F.col("l_discount") * 100).cast("int").cast("string")).when(k == 1, whole).when(k == 2, F.concat(F.lit("-"), whole)).otherwise(F.col("l_orderkey").cast("string"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))


_PCT_RULE = "CASE WHEN try_cast(raw AS DOUBLE) BETWEEN 0 AND 1 THEN try_cast(raw AS DOUBLE) * 100 WHEN try_cast(raw AS DOUBLE) > 1 AND try_cast(raw AS DOUBLE) <= 100 THEN try_cast(raw AS DOUBLE) END AS pct"
_PCT_RAW = "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 2 THEN '-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) END AS raw FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {_PCT_RULE} FROM ({_PCT_RAW})")
def match_confidence_pct(spark, d):
    return _line_texts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", S.confidence_pct(F.col("raw").try_cast("double")).alias("pct"))


_FLAG_RULE = "CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(raw)) IN ('false', '0', 'no') THEN false END AS matched"
_FLAG_RAW = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' True' WHEN 1 THEN CAST(o_custkey % 3 AS VARCHAR) WHEN 2 THEN CASE WHEN o_totalprice > 1000 THEN 'Yes' ELSE 'NO' END ELSE o_orderstatus END AS raw FROM orders"


@query(f"SELECT o_orderkey, {_FLAG_RULE} FROM ({_FLAG_RAW})")
def matched_flag(spark, d):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, " True").when(k == 1, (F.col("o_custkey") % 3).cast("string")).when(k == 2, F.when(F.col("o_totalprice") > 1000, "Yes").otherwise("NO")).otherwise(F.col("o_orderstatus"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", raw.alias("raw")).select("o_orderkey", S.matched_flag(F.col("raw")).alias("matched"))


_JSON_RULE = "coalesce(CASE WHEN json_valid(trim(raw)) AND trim(raw) LIKE '{%' THEN trim(raw) END, CASE WHEN json_valid(nullif(regexp_extract(raw, '(?s)(\\{.*\\})', 1), '')) THEN regexp_extract(raw, '(?s)(\\{.*\\})', 1) END) AS json".replace("\\\\", "\\")
_JSON_RAW = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'text ' || props || ' text' WHEN 2 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE event_type END AS raw FROM events"


@query(f"SELECT event_id, {_JSON_RULE} FROM ({_JSON_RAW})")
def llm_json_loose(spark, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("text "), "props", F.lit(" text"))).when(k == 2, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", raw.alias("raw")).select("event_id", S.json_loose(F.col("raw")).alias("json"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 3 THEN NULL WHEN s_suppkey % 4 = 2 THEN round(least(100.0, s_suppkey % 130), 1) WHEN s_suppkey % 4 = 1 THEN round(least(100.0, s_suppkey % 90), 1) ELSE round(least(100.0, 0.55 * (s_suppkey % 90) + 0.45 * (s_suppkey % 130)), 1) END AS DOUBLE) AS confidence FROM supplier")
def blend_confidence(spark, d):
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lex, model = F.when(k % 4 < 2, (k % 90).cast("double")), F.when((k % 4 == 0) | (k % 4 == 2), (k % 130).cast("double"))
    return s.select("s_suppkey", S.blend_confidence(lex, model).alias("confidence"))


# --- text


def _norm_sql(c: str) -> str:
    t = rf"lower(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')))"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\d+(?:\.\d+)?)\s+({T.UNITS})\b', '\1\2', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([a-z0-9])-([a-z0-9])', '\1\2', 'g')"
    return t


def _tokens_sql(c: str) -> str:
    cut = "regexp_replace(x, '(?:ies|sses|ses|ing|ed|s)$', '')"
    st = f"CASE WHEN length(x) >= 6 AND regexp_full_match(x, '[\\x00-\\x7F]*') AND regexp_matches(x, '[a-z]') AND length({cut}) >= 4 THEN {cut} ELSE x END"
    return rf"list_transform(list_filter(string_split_regex({_norm_sql(c)}, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''), lambda x: {st})"


_SIZED = "p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) || ' mm x-' || CAST(p_partkey AS VARCHAR)"


def sized(spark, d) -> DataFrame:
    p = spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    return p.select("p_partkey", "p_name", "p_type", "p_size", F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mm x-"), F.col("p_partkey").cast("string")).alias("t"))


@query(f"SELECT p_partkey, {_norm_sql(_SIZED)} AS description FROM part")
def normalize_cross_desc(spark, d):
    return sized(spark, d).select("p_partkey", T.normalize_desc(F.col("t")).alias("description"))


@query(f"SELECT doc_id, list_aggregate({_tokens_sql('text')}, 'string_agg', ' ') AS tokens, len({_tokens_sql('text')}) AS n_tokens FROM documents")
def tokenize_desc(spark, d):
    toks = T.tokens(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.nullif(F.array_join(toks, " "), F.lit("")).alias("tokens"), F.size(toks).cast("long").alias("n_tokens"))


_JC = f"""WITH t AS (SELECT p_partkey, list_distinct(list_filter({_tokens_sql("p_name || ' ' || p_type")}, lambda x: length(x) >= 3)) AS a3, list_distinct(list_filter({_tokens_sql(_SIZED)}, lambda x: length(x) >= 3)) AS b3,
  list_distinct(list_filter({_tokens_sql("p_name || ' ' || p_type")}, lambda x: length(x) >= 4)) AS a4, list_distinct(list_filter({_tokens_sql(_SIZED)}, lambda x: length(x) >= 4)) AS b4 FROM part),
u AS (SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a3, b3))) > 0 THEN len(list_intersect(a3, b3)) / len(list_distinct(list_concat(a3, b3))) ELSE 0.0 END AS j, CASE WHEN len(a4) > 0 THEN len(list_intersect(a4, b4)) / len(a4) ELSE 0.0 END AS c FROM t)
SELECT p_partkey, round(j, 6) AS jaccard, round(c, 6) AS coverage, round(least(1.0, greatest(0.0, 0.58 * j + (1 - 0.58 * j) * c * 0.68)), 6) AS score FROM u"""


@query(_JC)
def token_jaccard_coverage(spark, d):
    sets = sized(spark, d).select("p_partkey", T.token_set(T.tokens(F.concat_ws(" ", "p_name", "p_type")), 3).alias("a"), T.token_set(T.tokens(F.col("t")), 3).alias("b"))
    told = sets.select("p_partkey", T.jaccard(F.col("a"), F.col("b")).alias("j"), T.coverage(T.token_set(F.col("a"), 4), T.token_set(F.col("b"), 4)).alias("c"))
    return told.select("p_partkey", F.round("j", 6).alias("jaccard"), F.round("c", 6).alias("coverage"), F.round(T.blend(F.col("j"), F.col("c"), F.lit(0.0)), 6).alias("score"))


@query()
def similarity_score(spark, d):
    return sized(spark, d).select("p_partkey", F.round(T.similarity(F.concat_ws(" ", "p_name", "p_type"), F.col("t")), 6).alias("score"))


@query()
def vendor_fuzzy_match(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select("s_suppkey", X.same_vendor_fuzzy(F.col("s_name"), F.concat("s_name", F.lit(" Co."))).alias("same"))


_CANON = r"trim(regexp_replace(lower({0}), '[^0-9a-z\x{{0600}}-\x{{06ff}}]+', ' ', 'g'))"


def _singular_sql(x: str) -> str:
    return f"CASE WHEN length({x}) <= 3 OR NOT regexp_full_match({x}, '[a-z]+') OR {x} LIKE '%ss' THEN {x} WHEN {x} LIKE '%ies' AND length({x}) > 4 THEN left({x}, -3) || 'y' WHEN {x} LIKE '%es' AND length({x}) > 4 THEN left({x}, -2) WHEN {x} LIKE '%s' THEN left({x}, -1) ELSE {x} END"


_LOOSE = rf"array_to_string(list_transform(string_split(regexp_replace(regexp_replace({_CANON}, '([0-9])([a-z])', '\1 \2', 'g'), '([a-z])([0-9])', '\1 \2', 'g'), ' '), lambda x: {_singular_sql('CASE x WHEN ' + chr(39) + 'disc' + chr(39) + ' THEN ' + chr(39) + 'disk' + chr(39) + ' WHEN ' + chr(39) + 'disks' + chr(39) + ' THEN ' + chr(39) + 'disk' + chr(39) + ' WHEN ' + chr(39) + 'discs' + chr(39) + ' THEN ' + chr(39) + 'disk' + chr(39) + ' ELSE x END').replace('CASE x WHEN', '(CASE x WHEN').replace('ELSE x END', 'ELSE x END)')}), ' ')"


def _registry_sql(canon: str, where: str = "true") -> str:
    return f"SELECT {canon} AS canonical_desc, array_to_string(list_sort(list_distinct(list(CAST(p_partkey AS VARCHAR)))), ',') AS item_keys FROM part WHERE {where} GROUP BY 1"


def parts(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_partkey").cast("string").alias("item_no"), F.col("p_name").alias("item_description"), F.concat_ws(" ", "p_name", "p_type", "p_size").alias("long"))


def _joined(reg: DataFrame) -> DataFrame:
    return reg.withColumn("item_keys", F.array_join("item_keys", ","))


@query(_registry_sql(_CANON.format("p_name")))
def canonical_registry(spark, d):
    return _joined(C.registry(parts(spark, d)))


@query(_registry_sql(_LOOSE.format("(p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR))")))
def canonical_registry_loose(spark, d):
    return _joined(C.registry(parts(spark, d), "long", loose=True))


@query(f"SELECT count(*) AS n_descriptions, CAST(sum(n) AS BIGINT) AS n_codes, max(n) AS max_codes FROM (SELECT {_CANON.format('p_name')} AS c, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1)")
def registry_summary(spark, d):
    return C.summary(C.registry(parts(spark, d)))


@query(_registry_sql(_CANON.format("p_name")))
def registry_merge(spark, d):
    p = parts(spark, d)
    return _joined(C.merge(C.registry(p.where("p_partkey % 2 = 0")), C.registry(p.where("p_partkey % 3 > 0 OR p_partkey % 2 = 1"))))


@query(f"SELECT p_partkey, {_CANON.format('p_name')} AS canonical_desc, n FROM part JOIN (SELECT {_CANON.format('p_name')} AS c, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1) ON c = {_CANON.format('p_name')}")
def registry_lookup(spark, d):
    p = parts(spark, d)
    got = C.lookup(C.registry(p), p.select("p_partkey", F.col("item_description").alias("text")))
    return got.select("p_partkey", "canonical_desc", F.size("item_keys").cast("long").alias("n"))


# --- schema alignment and the work frame


@query(f"WITH {ERP_SQL} SELECT item_no, item_description, unit_cost, vendor, po_number, line_no FROM erp")
def header_alias_rename(spark, d):
    e = erp.erp_lines(spark, d)
    odd = e.select(F.col("item_no").alias("  Stock  Code "), F.col("item_description").alias("LONG DESCRIPTION"), F.col("unit_cost").alias("Net Price"), F.col("vendor").alias("Supplier Name"), F.col("po_number").alias("P.O."), "line_no")
    return erp.rename_by_alias(odd).select("item_no", "item_description", "unit_cost", "vendor", "po_number", "line_no")


@query(f"WITH {ERP_SQL} SELECT item_no, po_number, line_no, CAST(unit_cost AS DOUBLE) AS unit_cost FROM erp")
def ensure_unit_cost(spark, d):
    e = erp.erp_lines(spark, d).select("item_no", "po_number", "line_no", F.lit("n/a").alias("unit_cost"), F.lit("").alias("rate"), (F.col("unit_cost") * 2).alias("Total Price"), F.col("unit_cost").alias("Offer Price"))
    return erp.ensure_unit_cost(e).select("item_no", "po_number", "line_no", F.col("unit_cost").cast("double").alias("unit_cost"))


@query(f"WITH {ERP_SQL} SELECT po_number, line_no, item_no, vendor, unit_cost, qty, item_description FROM erp")
def positional_fallback(spark, d):
    e = erp.erp_lines(spark, d)
    at = {1: "po_number", 6: "item_description", 7: "qty", 8: "unit", 9: "unit_cost", 15: "vendor", 22: "po_order_date"}
    wide = e.select(*[F.col(at[i]).alias(f"_c{i}") if i in at else F.lit("").alias(f"_c{i}") for i in range(23)], "line_no", "item_no", F.lit("").alias("vendor"))
    return erp.positional_fallback(wide, "MBL").select("po_number", "line_no", "item_no", "vendor", "unit_cost", "qty", "item_description")


@query(f"WITH {ERP_SQL} SELECT company_tab, item_no, po_number, line_no, qty, unit_cost FROM erp WHERE company_tab = 'IFAS'")
def company_slice(spark, d):
    return erp.select_company(erp.erp_lines(spark, d), "IFAS").select("company_tab", "item_no", "po_number", "line_no", "qty", "unit_cost")


def rough(spark, d) -> DataFrame:
    """Lines with costs to the thousand, so that receipts repeat."""
    return erp.erp_lines(spark, d).withColumn("unit_cost", F.floor(F.col("unit_cost") / 1000) * 1000.0)


@query(f"WITH {ERP_SQL.replace('l_extendedprice / l_quantity AS unit_cost', 'floor(l_extendedprice / l_quantity / 1000) * 1000.0 AS unit_cost')} SELECT {_LINE} FROM erp QUALIFY row_number() OVER (PARTITION BY item_key, item_description, unit_cost, vendor ORDER BY po_order_date DESC NULLS LAST, {_TIE}) = 1")
def receipt_dedupe(spark, d):
    return W.receipt_dedupe(B.keyed(rough(spark, d))).select(*_COLS)


@query(f"WITH {ERP_SQL} SELECT item_no, po_number, line_no, vendor, qty, unit_cost FROM erp WHERE line_no NOT IN (6, 7)")
def drop_unpriceable(spark, d):
    e = erp.erp_lines(spark, d)
    bad = e.withColumn("unit_cost", F.when(F.col("line_no") != 7, F.col("unit_cost"))).withColumn("item_no", F.when(F.col("line_no") == 6, " ").otherwise(F.col("item_no")))
    return W.drop_unpriceable(bad).select("item_no", "po_number", "line_no", "vendor", "qty", "unit_cost")


@query(f"WITH {ERP_SQL} SELECT company_tab, row_number() OVER (PARTITION BY company_tab ORDER BY po_order_date DESC NULLS LAST, {_TIE}) AS work_ord, item_no, po_number, line_no FROM erp")
def work_frame_sorted(spark, d):
    return W.newest_first(erp.erp_lines(spark, d)).select("company_tab", "work_ord", "item_no", "po_number", "line_no")


@query(f"WITH {ERP_SQL} SELECT company_tab, item_no, po_number, line_no, work_ord FROM (SELECT *, row_number() OVER (PARTITION BY company_tab ORDER BY po_order_date DESC NULLS LAST, {_TIE}) AS work_ord FROM erp) WHERE work_ord <= 50")
def no_shortlist_fallback(spark, d):
    return W.top(erp.erp_lines(spark, d), 50).select("company_tab", "item_no", "po_number", "line_no", "work_ord")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, CAST(l_suppkey AS VARCHAR) AS suppkey FROM lineitem")
def object_normalizer(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", F.col("l_suppkey").alias("suppkey"))
    n = erp.normalize_objects(li)
    return n.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("long"), F.col("l_quantity").cast("double"), "l_returnflag", "suppkey")


@query("SELECT l_suppkey AS line, substring('item' || chr(9) || 'qty' || chr(10) || string_agg(CAST(l_partkey AS VARCHAR) || chr(9) || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity), 1, 120000) AS tsv FROM lineitem GROUP BY l_suppkey")
def tsv_export(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.select(F.col("l_suppkey").alias("line"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("qty"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("rank"))
    return erp.tsv_payload(rows, "line", ["item", "qty"])


# --- retrieval


def _docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")


def _asked(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("q"), T.tokens(F.col("text")).alias("terms"))


_BM25 = f"""t AS (SELECT doc_id AS doc, {_tokens_sql("text")} AS toks FROM documents),
len AS (SELECT doc, len(toks) AS dl FROM t), post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM t) GROUP BY doc, term),
n AS (SELECT count(*) AS nd, avg(dl) AS avgdl FROM len), raw AS (SELECT term, ln((nd - count(*) + 0.5) / (count(*) + 0.5)) AS r FROM post, n GROUP BY term, nd),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT item_id AS q, unnest({_tokens_sql("text")}) AS term FROM benchmark) GROUP BY q, term),
s AS (SELECT q, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN len USING (doc), n GROUP BY q, doc)"""


@query(f"WITH {_BM25} SELECT q, doc, round(score, 3) AS score FROM s")
def bm25_scores(spark, d):
    s = V.bm25_scores(V.bm25_index(_docs(spark, d), T.tokens(F.col("text"))), _asked(spark, d))
    return s.withColumn("score", F.round("score", 3))


_TOPK = f"{_BM25}, z AS (SELECT q, doc, coalesce(score, 0.0) AS score FROM (SELECT item_id AS q FROM benchmark) CROSS JOIN len LEFT JOIN s USING (q, doc)), k AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM z QUALIFY rank <= 30)"


@query(f"WITH {_TOPK} SELECT q, doc, rank, round(score, 3) AS score FROM k")
def bm25_topk(spark, d):
    k = V.bm25_topk(V.bm25_index(_docs(spark, d), T.tokens(F.col("text"))), _asked(spark, d))
    return k.select("q", "doc", "rank", F.round("score", 3).alias("score"))


@query(f"WITH {_TOPK}, m AS (SELECT q % 7 AS line, doc, max(score) AS score FROM k GROUP BY 1, 2) SELECT line, doc, row_number() OVER (PARTITION BY line ORDER BY score DESC, doc) AS rank, round(score, 3) AS score FROM m QUALIFY rank <= 50")
def bm25_merge_max(spark, d):
    k = V.bm25_topk(V.bm25_index(_docs(spark, d), T.tokens(F.col("text"))), _asked(spark, d))
    m = V.merge_max(k.withColumn("line", F.col("q") % 7))
    return m.select("line", "doc", "rank", F.round("score", 3).alias("score"))


def _vectors(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias(name), F.col("embedding").alias("vec"))


_KNN = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings), k AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(greatest(-1.0, least(1.0, list_dot_product(a.v, b.v) / (a.n * b.n))), 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(greatest(-1.0, least(1.0, list_dot_product(a.v, b.v) / (a.n * b.n))), 6) DESC, b.vec_id) AS rank FROM e a, e b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 30)"


@query(f"WITH {_KNN} SELECT q, doc, sim, rank FROM k")
def knn_topk(spark, d):
    v = _vectors(spark, d, "q")
    return V.knn(v.where("q % 20 = 0"), _vectors(spark, d, "doc")).select("q", "doc", "sim", "rank")


_LISTS = "b AS (SELECT l_suppkey AS q, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2 QUALIFY rank <= 30), e AS (SELECT l_suppkey AS q, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2 QUALIFY rank <= 30), f AS (SELECT q, doc, round(coalesce(1.0 / (60 + b.rank - 1), 0.0) + coalesce(1.0 / (60 + e.rank - 1), 0.0), 9) AS score, CASE WHEN b.rank IS NOT NULL AND e.rank IS NOT NULL THEN 'hybrid' WHEN b.rank IS NOT NULL THEN 'bm25' ELSE 'emb' END AS source FROM b FULL JOIN e USING (q, doc)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 50)"


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    g = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("doc")).agg(F.max("l_quantity").alias("a"), F.max("l_extendedprice").alias("b"))
    return tuple(V.ranked(g, "q", F.desc(c), F.asc("doc")).where(F.col("rank") <= 30).select("q", "doc", "rank") for c in ("a", "b"))


@query(f"WITH {_LISTS} SELECT q, doc, score, rank FROM r")
def rrf_fusion(spark, d):
    return V.rrf(*_lists(spark, d)).select("q", "doc", "score", "rank")


@query(f"WITH {_LISTS} SELECT q, source, count(*) AS n FROM r GROUP BY q, source")
def hybrid_membership(spark, d):
    return V.rrf(*_lists(spark, d)).groupBy("q", "source").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TOPK}, {_KNN.replace(", k AS (SELECT a.vec_id", ", n30 AS (SELECT a.vec_id")},
f AS (SELECT coalesce(b.q, v.q // 20) AS line, doc, round(coalesce(1.0 / (60 + b.rank - 1), 0.0) + coalesce(1.0 / (60 + v.rank - 1), 0.0), 9) AS fused, b.score AS bm25, coalesce(v.sim, 0.0) AS cos, CASE WHEN b.rank IS NOT NULL AND v.rank IS NOT NULL THEN 'hybrid' WHEN b.rank IS NOT NULL THEN 'bm25' ELSE 'emb' END AS source
      FROM k b FULL JOIN (SELECT q // 20 AS q, doc, sim, rank FROM n30) v USING (q, doc)),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY fused DESC, doc) AS ord FROM f QUALIFY ord <= 50),
l AS (SELECT *, CASE WHEN max(bm25) OVER (PARTITION BY line) > 0 THEN round(coalesce(bm25, 0.0) / max(bm25) OVER (PARTITION BY line), 2) ELSE 0.0 END AS lex FROM o),
h AS (SELECT line, doc, source, round(0.5 * lex + 0.5 * greatest(0.0, cos), 6) AS score, row_number() OVER (PARTITION BY line ORDER BY round(0.5 * lex + 0.5 * greatest(0.0, cos), 6) DESC, ord, doc) AS rank FROM l)
SELECT line, doc, source, round(score, 3) AS score, rank FROM h WHERE rank <= 10""".replace("v.q // 20", "v.q")
)
def hybrid_candidates(spark, d):
    """BM25 over documents and neighbours over embeddings, fused by rank and reranked by both scores; a line is a benchmark text and every twentieth vector."""
    by_term = V.bm25_topk(V.bm25_index(_docs(spark, d), T.tokens(F.col("text"))), _asked(spark, d))
    v = _vectors(spark, d, "q")
    by_vector = V.knn(v.where("q % 20 = 0"), _vectors(spark, d, "doc")).withColumn("q", F.floor(F.col("q") / 20).cast("long"))
    by_term, by_vector = cut(by_term), cut(by_vector)
    fused = V.rrf(by_term.select("q", "doc", "rank"), by_vector.select("q", "doc", "rank")).select("q", "doc", "source", F.col("rank").alias("ord"))
    told = fused.join(by_term.select("q", "doc", F.col("score").alias("bm25")), ["q", "doc"], "left").join(by_vector.select("q", "doc", F.col("sim").alias("cos")), ["q", "doc"], "left")
    top = F.max("bm25").over(Window.partitionBy("q"))
    told = told.withColumn("lex", F.when(top > 0, F.round(F.coalesce("bm25", F.lit(0.0)) / top, 2)).otherwise(0.0)).withColumn("penalty", F.lit(0.0)).withColumnRenamed("q", "line")
    return R.hybrid(told).select("line", "doc", "source", F.round("score", 3).alias("score"), "rank")


@query(f"SELECT q, p_partkey AS doc, max(sim) AS sim FROM (SELECT n_nationkey AS q, {_CANON.format('p_name')} AS c, (length(p_name) % 10 + n_nationkey) / 100.0 AS sim FROM part, nation WHERE n_nationkey < 3) JOIN part ON c = {_CANON.format('p_name')} GROUP BY 1, 2")
def expand_hits(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.canonical(F.col("p_name")).alias("canonical_desc"), F.length("p_name").alias("n"))
    hits = p.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("q"), "canonical_desc", "n").select("q", "canonical_desc", ((F.col("n") % 10 + F.col("q")) / 100.0).alias("sim")).distinct()
    return V.expand(hits, p.select(F.col("p_partkey").alias("doc"), "canonical_desc"))


def _wanted(spark, d) -> DataFrame:
    return erp.erp_lines(spark, d).select("company_tab", T.canonical(F.col("item_description")).alias("canonical_desc"))


_WANTED = f"w AS (SELECT DISTINCT company_tab, {_CANON.format('item_description')} AS canonical_desc FROM erp), i AS (SELECT DISTINCT company_tab, {_CANON.format('item_description')} AS canonical_desc FROM erp WHERE po_order_date < DATE '{INDEXED_BEFORE}')"


def _indexed(spark, d) -> DataFrame:
    """The snapshot of an index that was made of the lines before INDEXED_BEFORE."""
    index = SnapshotTable.fresh(spark, index_stream.SCHEMA, index_stream.KEYS)
    index_stream.extend(erp.erp_lines(spark, d).where(F.col("po_order_date") < INDEXED_BEFORE), index)
    return index.read(index.version())


@query(f"WITH {ERP_SQL}, {_WANTED} SELECT company_tab, canonical_desc FROM w WHERE canonical_desc <> '' EXCEPT SELECT company_tab, canonical_desc FROM i")
def index_delta(spark, d):
    return V.missing_descriptions(_wanted(spark, d), _indexed(spark, d))


@query(f"WITH {ERP_SQL}, {_WANTED}, r AS (SELECT company_tab, count(*) AS registry_size FROM w GROUP BY company_tab), j AS (SELECT company_tab, count(*) AS index_size FROM i GROUP BY company_tab) SELECT company_tab, registry_size, coalesce(index_size, 0) AS index_size, coalesce(index_size, 0) >= floor(registry_size * 0.99) AS ready FROM r LEFT JOIN j USING (company_tab)")
def index_status(spark, d):
    return V.index_status(_wanted(spark, d).distinct(), _indexed(spark, d))


@query()
def hash_embedding(spark, d):
    p = sized(spark, d).select("p_partkey", V.hash_embed(T.tokens(F.col("t"))).alias("vec"))
    return p.select("p_partkey", F.array_join(F.transform("vec", lambda v: F.round(v, 6).cast("string")), ",").alias("vec"))


# --- attributes and rerankers


@query(r"SELECT p_partkey, CAST(regexp_extract(t, '(\d{1,4})\s*mm', 1) AS DOUBLE) AS size_mm FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || ' mm' AS t FROM part)")
def attr_extract_size(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", A.extract(F.concat(F.col("p_size").cast("string"), F.lit(" mm"))).alias("a")).select("p_partkey", F.col("a.size_mm.value").alias("size_mm"))


@query()
def attr_extract(spark, d):
    a = sized(spark, d).select("p_partkey", A.extract(F.col("t")).alias("a"), "t")
    return a.select("p_partkey", *[F.col(f"a.{n}.value").alias(n) for n in A.NAMES], A.needs_model(F.col("t"), F.col("a")).alias("needs_model"))


_FILTER = """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS q, CAST(p_size % 23 + 1 AS DOUBLE) AS c FROM part),
f AS (SELECT p_partkey, abs(q - c) <= 0.5 OR abs(q - c) <= 0.1 * greatest(q, c) AS close, p_partkey % 3 = 0 AS unsure, p_partkey % 5 = 0 AS missing, p_partkey % 2 = 0 AS wood FROM p)
SELECT p_partkey, missing OR close OR unsure AS keep, CAST(CASE WHEN NOT (missing OR close OR unsure) THEN 0.0 ELSE round(CASE WHEN missing THEN 0.1 WHEN close THEN 0.0 ELSE 0.4 END + CASE WHEN wood THEN 0.4 ELSE 0.0 END, 6) END AS DOUBLE) AS penalty FROM f"""


@query(_FILTER)
def attr_filter(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    num = lambda v, c: F.struct(v.cast("double").alias("value"), c.alias("conf"))
    none = F.lit(None).cast("struct<value:double,conf:double>")
    word = lambda w: F.struct(w.alias("value"), F.lit(1.0).alias("conf"))
    k = F.col("p_partkey")
    q = F.struct(num(F.col("p_size"), F.lit(1.0)).alias("size_mm"), *[none.alias(n) for n in ("size_inch", "voltage", "pack_size", "capacity_l")], word(F.lit("steel")).alias("material"))
    c = F.struct(F.when(k % 5 != 0, num(F.col("p_size") % 23 + 1, F.when(k % 3 == 0, 0.7).otherwise(1.0))).alias("size_mm"), *[none.alias(n) for n in ("size_inch", "voltage", "pack_size", "capacity_l")], word(F.when(k % 2 == 0, "wood").otherwise("steel")).alias("material"))
    return p.select("p_partkey", q.alias("q"), c.alias("c")).select("p_partkey", A.decide(F.col("q"), F.col("c")).alias("f")).select("p_partkey", "f.keep", "f.penalty")


def cands(spark, d) -> DataFrame:
    """A line a supplier, its candidates the parts that it delivers."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("line"), F.col("l_partkey").alias("doc")).agg(F.max("l_discount").alias("lex"), F.max("l_tax").alias("cos"), F.min("l_quantity").alias("ord"))
    p = spark.read.parquet(f"{d}/part.parquet")
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 25).cast("string").alias("nk"))
    return li.join(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_partkey").cast("string").alias("item_key")), F.col("doc") == F.col("p_partkey")).drop("p_partkey").withColumn("penalty", F.when(F.col("doc") % 4 == 0, 0.1).otherwise(0.0)).withColumn("query", F.concat(F.lit("steel brass "), F.col("line").cast("string")))


_CANDS = "g AS (SELECT l_suppkey AS line, l_partkey AS doc, max(l_discount) AS lex, max(l_tax) AS cos, min(l_quantity) AS ord FROM lineitem GROUP BY 1, 2), h AS (SELECT *, round(0.5 * lex + 0.5 * greatest(0.0, cos) - CASE WHEN doc % 4 = 0 THEN 0.1 ELSE 0.0 END, 6) AS score FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, ord, doc) AS rank FROM h QUALIFY rank <= 10), m AS (SELECT *, max(score) OVER (PARTITION BY line) AS top1, round(max(score) OVER (PARTITION BY line) - coalesce(max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY line), max(score) OVER (PARTITION BY line)), 6) AS margin FROM r)"


@query(f"WITH {_CANDS} SELECT line, doc, rank, score, top1, margin FROM m")
def rerank_hybrid(spark, d):
    return R.hybrid(cands(spark, d)).select("line", "doc", "rank", "score", "top1", "margin")


@query(f"WITH {_CANDS} SELECT line, bool_and(top1 >= 0.06 AND margin >= 0.01) AS skip FROM m GROUP BY line")
def ce_skip_rule(spark, d):
    h = R.hybrid(cands(spark, d))
    return h.groupBy("line").agg(F.bool_and(R.skip_model(F.col("top1"), F.col("margin"), 0.06, 0.01)).alias("skip"))


@query("WITH g AS (SELECT l_suppkey AS line, l_partkey AS doc, min(l_quantity) AS ord FROM lineitem GROUP BY 1, 2), s AS (SELECT line, doc, ord, round((line * 7 + doc * 13) % 97 / 100.0 - 0.9 - CASE WHEN doc % 4 = 0 THEN 0.1 ELSE 0.0 END, 6) AS score FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, ord, doc) AS rank FROM s QUALIFY rank <= 10) SELECT line, doc, rank, score, max(score) OVER (PARTITION BY line) < 0.0 AS abstain FROM r")
def abstain_flag(spark, d):
    rows = cands(spark, d)
    scored = rows.withColumn("query", F.col("line").cast("string")).withColumn("text", F.col("doc").cast("string"))
    scorer = lambda q, t: (q.cast("long") * 7 + t.cast("long") * 13) % 97 / 100.0 - 0.9
    return R.cross_encoder(scored, scorer).select("line", "doc", "rank", "score", "abstain")


@query(f"WITH {_CANDS} SELECT line, doc, rank, score FROM m WHERE rank <= 3")
def per_line_topk(spark, d):
    return R.hybrid(cands(spark, d), 3).select("line", "doc", "rank", "score")


#: Before items are excluded the pool of a line is its first 50.
_POOL = _CANDS.replace("rank <= 10", "rank <= 50")


@query(f"WITH {_POOL}, k AS (SELECT *, doc % 3 <> 0 AS keep, bool_or(doc % 3 <> 0) OVER (PARTITION BY line) AS any_kept FROM m) SELECT * FROM (SELECT line, doc, score, row_number() OVER (PARTITION BY line ORDER BY score DESC, doc) AS rank FROM k WHERE keep OR NOT any_kept) WHERE rank <= 3")
def item_exclusion(spark, d):
    rows = cands(spark, d)
    return R.rerank(rows, None, 3, rows.where("doc % 3 = 0").select("line", "item_key")).select("line", "doc", "score", "rank")


@query(f"WITH {_CANDS} SELECT least(greatest(max(n), 2), 12) AS cap FROM (SELECT line, count(*) AS n FROM m GROUP BY line)")
def merged_cap(spark, d):
    return R.merged_cap(R.hybrid(cands(spark, d))).select(F.col("cap").cast("long").alias("cap"))


@query(f"WITH {_CANDS} SELECT line, stage, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY rank) AS docs FROM (SELECT line, doc, rank, 'shortlist' AS stage FROM m UNION ALL SELECT line, doc, rank, 'output' FROM m WHERE rank <= 3) GROUP BY line, stage")
def staged_diagnostics(spark, d):
    h = R.hybrid(cands(spark, d))
    return R.stages(shortlist=h, output=h.where("rank <= 3")).withColumn("docs", F.array_join("docs", ","))


@query()
def rerank_lexical(spark, d):
    return R.lexical(cands(spark, d)).select("line", "doc", "rank", "score")


_RERANKED = f"""WITH {_TOPK}, l AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY q) > 0 THEN round(score / max(score) OVER (PARTITION BY q), 2) ELSE 0.0 END AS lex FROM k),
h AS (SELECT q, doc, rank AS ord, round(0.5 * lex + 0.5 * greatest(0.0, lex), 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(0.5 * lex + 0.5 * greatest(0.0, lex), 6) DESC, rank, doc) AS place FROM l),
m AS (SELECT *, max(score) OVER (PARTITION BY q) AS top1, round(max(score) OVER (PARTITION BY q) - coalesce(max(CASE WHEN place = 2 THEN score END) OVER (PARTITION BY q), max(score) OVER (PARTITION BY q)), 6) AS margin FROM h),
qs AS (SELECT item_id AS q, list_distinct(list_filter(t, lambda x: length(x) >= 3)) AS a3, list_distinct(list_filter(t, lambda x: length(x) >= 4)) AS a4 FROM (SELECT item_id, {_tokens_sql("text")} AS t FROM benchmark)),
ds AS (SELECT doc, list_distinct(list_filter(toks, lambda x: length(x) >= 3)) AS b3, list_distinct(list_filter(toks, lambda x: length(x) >= 4)) AS b4 FROM t WHERE doc IN (SELECT doc FROM k)),
c AS (SELECT m.*, round(least(1.0, greatest(0.0, 0.58 * j + (1 - 0.58 * j) * cov * 0.68)), 6) AS ce FROM m JOIN (SELECT m.q AS q2, m.doc AS doc2, CASE WHEN len(list_distinct(list_concat(a3, b3))) > 0 THEN len(list_intersect(a3, b3)) / len(list_distinct(list_concat(a3, b3))) ELSE 0.0 END AS j, CASE WHEN len(a4) > 0 THEN len(list_intersect(a4, b4)) / len(a4) ELSE 0.0 END AS cov FROM m JOIN qs ON qs.q = m.q JOIN ds ON ds.doc = m.doc) ON q2 = q AND doc2 = doc),
r AS (SELECT q, doc, top1 >= 0.85 AND margin >= 0.2 AS sure, score, ce, ord, place, row_number() OVER (PARTITION BY q ORDER BY ce DESC, ord, doc) AS ce_place FROM c)
SELECT q AS line, doc, CASE WHEN sure THEN score ELSE ce END AS score, CASE WHEN sure THEN place ELSE ce_place END AS rank, NOT sure AS by_model FROM r WHERE CASE WHEN sure THEN place ELSE ce_place END <= 10"""


@query(_RERANKED)
def rerank_pipeline(spark, d):
    """The documents that BM25 finds for each benchmark text; where its lead isn't sure, the pair scorer orders all of them."""
    index = V.bm25_index(_docs(spark, d), T.tokens(F.col("text")))
    top = cut(V.bm25_topk(index, _asked(spark, d)))
    best = F.max("score").over(Window.partitionBy("q"))
    rows = top.withColumn("lex", F.when(best > 0, F.round(F.col("score") / best, 2)).otherwise(0.0)).select(F.col("q").alias("line"), "doc", "lex", F.col("lex").alias("cos"), F.lit(0.0).alias("penalty"), F.col("rank").alias("ord"))
    texts = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("line"), F.col("text").alias("query"))
    told = cut(rows.join(texts, "line").join(_docs(spark, d), "doc"))
    return R.rerank(told, T.token_score).select("line", "doc", "score", "rank", "by_model")


_SCOPE = "WITH p AS (SELECT p_partkey AS line, n_nationkey AS idx, n_name AS txt, ((p_partkey * 3 + n_nationkey * 5) % 20) / 20.0 AS cos, CAST((p_partkey + n_nationkey) % 7 AS DOUBLE) AS bm FROM part, nation), s AS (SELECT *, round(0.65 * greatest(0.0, cos) + (1 - 0.65) * CASE WHEN max(bm) OVER (PARTITION BY line) > 0 THEN bm / max(bm) OVER (PARTITION BY line) ELSE 0.0 END, 4) AS score FROM p) SELECT line, score >= 0.55 AS in_scope, score AS confidence, CASE WHEN score >= 0.55 THEN txt END AS matched_scope_text, 'hybrid' AS method FROM s QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, idx) = 1"


@query(_SCOPE)
def scope_match(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("line"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("scope_idx"), F.col("n_name").alias("scope_text"))
    pairs = p.crossJoin(F.broadcast(n)).withColumn("cos", ((F.col("line") * 3 + F.col("scope_idx") * 5) % 20) / 20.0).withColumn("bm25", ((F.col("line") + F.col("scope_idx")) % 7).cast("double"))
    return R.scope_match(pairs)


# --- cross-company matching


def _work(spark, d, tab: str) -> DataFrame:
    """One row a part that a company has bought: its newest line."""
    e = B.latest(B.keyed(erp.erp_lines(spark, d).where(F.col("company_tab") == tab)))
    return e.withColumn("doc", F.col("item_key").cast("long"))


def _asking(spark, d) -> DataFrame:
    """A line an item of IFAS; odd codes are foreign ones, which no company has."""
    e = B.latest(B.keyed(erp.erp_lines(spark, d).where("company_tab = 'IFAS'")))
    k = F.col("item_key").cast("long")
    return e.select(k.alias("line"), k.alias("pos"), F.when(k % 2 == 1, F.concat(F.lit("X"), "item_no")).otherwise(F.col("item_no")).alias("item_no"), F.col("item_description").alias("description"))


_SIDES = f"{ERP_SQL}, m AS (SELECT * FROM erp WHERE company_tab = 'MBL' QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY po_order_date DESC NULLS LAST, {_TIE}) = 1), i AS (SELECT * FROM erp WHERE company_tab = 'IFAS' QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY po_order_date DESC NULLS LAST, {_TIE}) = 1)"


@query(f"WITH {_SIDES} SELECT CAST(i.item_key AS BIGINT) AS line, m.item_no AS ref_item_no, m.item_description AS ref_item_description, m.unit_cost AS ref_unit_cost, m.unit AS ref_unit, m.po_number AS ref_po_number, m.po_order_date AS ref_po_order_date, m.vendor AS ref_vendor, m.project_name AS ref_project_name, 'exact_code' AS provenance, 100.0::DOUBLE AS confidence FROM i JOIN m USING (item_key) WHERE CAST(i.item_key AS BIGINT) % 2 = 0")
def exact_code_match(spark, d):
    return X.exact_code(_asking(spark, d), _work(spark, d, "MBL"))


def _answers(spark, d, answered=None, asking=None) -> DataFrame:
    """A model's answer for every foreign IFAS code (or those ``answered``), one object of JSON."""
    e = (_asking(spark, d) if asking is None else asking).where("line % 2 = 1").where(F.lit(True) if answered is None else answered)
    one = F.to_json(F.struct(F.col("item_no").alias("itemNo"), F.struct((F.col("line") * 1.5).alias("unitCost"), F.lit("V").alias("vendor")).alias("best_match"), F.lit(0.8).alias("confidence"), (F.col("line") % 4 == 1).alias("matched")))
    return e.select(F.concat(F.lit('Here: {"matches": ['), one, F.lit("]}")).alias("answer"))


@query("SELECT count(*) AS n, CAST(sum(unit_cost * 2) AS BIGINT) AS twice FROM (SELECT DISTINCT l_partkey, l_partkey * 1.5 AS unit_cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey % 3 = 1 AND l_partkey % 2 = 1)")
def llm_match_extraction(spark, d):
    m = _answers(spark, d).select(F.inline(responses.parse_matches("answer")))
    return m.agg(F.count("*").alias("n"), F.sum(F.col("unit_cost").cast("double") * 2).cast("long").alias("twice"))


@query(f"WITH {_SIDES} SELECT CAST(item_key AS BIGINT) AS line, 'X' || item_no AS ref_item_no, CAST(NULL AS VARCHAR) AS ref_item_description, CAST(item_key AS BIGINT) * 1.5::DOUBLE AS ref_unit_cost, CAST(NULL AS VARCHAR) AS ref_unit, CASE WHEN CAST(item_key AS BIGINT) % 4 = 1 THEN 'Ref. desc match' ELSE 'Ref. desc match (review)' END AS ref_po_number, CAST(NULL AS DATE) AS ref_po_order_date, 'V' AS ref_vendor, CAST(NULL AS VARCHAR) AS ref_project_name, 'ai_tagged' AS provenance, 80.0::DOUBLE AS confidence FROM i WHERE CAST(item_key AS BIGINT) % 2 = 1")
def apply_matches(spark, d):
    asking = cut(_asking(spark, d))
    return X.apply_matches(asking, _answers(spark, d, asking=asking).select(F.inline(responses.parse_matches("answer"))))


_TS = _tokens_sql("item_description")
_KEPT = "list_distinct(list_filter(t, lambda x: length(x) >= 3)) AS t3, list_distinct(list_filter(t, lambda x: length(x) >= 4)) AS t4"
_BEST = f"""x AS (SELECT *, {_TS} AS t FROM i), y AS (SELECT *, {_TS} AS t FROM m),
a AS (SELECT CAST(item_key AS BIGINT) AS line, {_KEPT} FROM x), c AS (SELECT *, CAST(item_key AS BIGINT) AS doc, {_KEPT} FROM y),
u AS (SELECT a.line, c.*, CASE WHEN len(list_distinct(list_concat(a.t3, c.t3))) > 0 THEN len(list_intersect(a.t3, c.t3)) / len(list_distinct(list_concat(a.t3, c.t3))) ELSE 0.0 END AS j, CASE WHEN len(a.t4) > 0 THEN len(list_intersect(a.t4, c.t4)) / len(a.t4) ELSE 0.0 END AS cov FROM a JOIN c ON c.unit_cost IS NOT NULL AND list_has_any(a.t3, c.t3)),
s AS (SELECT *, round(least(1.0, greatest(0.0, 0.58 * j + (1 - 0.58 * j) * cov * 0.68)), 6) AS sim FROM u),
best AS (SELECT line, item_no AS ref_item_no, item_description AS ref_item_description, unit_cost AS ref_unit_cost, unit AS ref_unit, po_number AS ref_po_number, po_order_date AS ref_po_order_date, vendor AS ref_vendor, project_name AS ref_project_name, sim FROM s QUALIFY row_number() OVER (PARTITION BY line ORDER BY sim DESC, doc) = 1)"""


def _best_sql(floor: float, provenance: str) -> str:
    return f"WITH {_SIDES}, {_BEST} SELECT * EXCLUDE (sim), '{provenance}' AS provenance, round(sim * 100, 1) AS confidence FROM best WHERE sim >= {floor}"


@query(_best_sql(0.22, "lexical_fallback"))
def lexical_fallback(spark, d):
    """The last resort: for each line the best of all the other company's rows, by the bounded join."""
    return X.lexical_anywhere(_asking(spark, d), _work(spark, d, "MBL"), score=T.token_score)


@query(_best_sql(0.0, "rematch_lexical"))
def rematch_polish(spark, d):
    """The most similar candidate of each line; candidates are those that BM25 finds."""
    asking = cut(_asking(spark, d))
    return X.lexical_best(asking, X.candidates(asking, cut(_work(spark, d, "MBL")), score=T.token_score, embed=None), floor=0.0, score=T.token_score, provenance="rematch_lexical")


def _matched(spark, d) -> DataFrame:
    asking = cut(_asking(spark, d))
    return X.match(asking, _work(spark, d, "MBL"), _answers(spark, d, F.col("line") % 3 != 0, asking), T.token_score, embed=None)


#: A line with a code that MBL has takes its row; of the others a model has priced two in three, and the best row of all by token score is what those and the rest stand for.
_E2E = f"""WITH {_SIDES}, {_BEST}, l AS (SELECT CAST(item_key AS BIGINT) AS line, CASE WHEN CAST(item_key AS BIGINT) % 2 = 1 THEN 'X' ELSE '' END || item_no AS item_no, item_description FROM i),
e AS (SELECT l.line, m.item_no AS ref_item_no, m.item_description AS ref_desc, m.unit_cost AS ref_unit_cost, m.po_order_date, m.vendor FROM l JOIN m ON CAST(m.item_key AS BIGINT) = l.line WHERE l.line % 2 = 0),
o AS (SELECT l.line, l.item_no, e.line IS NOT NULL AS exact, l.line % 2 = 1 AND l.line % 3 <> 0 AS told, e.ref_item_no AS e_no, e.ref_unit_cost AS e_cost, e.po_order_date AS e_date, b.* EXCLUDE (line) FROM l LEFT JOIN e USING (line) LEFT JOIN best b ON b.line = l.line AND b.sim >= 0.22),
p AS (SELECT *, CASE WHEN exact THEN 'exact_code' WHEN told THEN 'ai_tagged' WHEN sim IS NOT NULL THEN 'lexical_fallback' END AS provenance, round(sim * 100, 1) AS lex FROM o)
"""


@query(
    f"""{_E2E} SELECT line, item_no, provenance IS NOT NULL AS matched, provenance, CASE WHEN exact THEN e_no ELSE ref_item_no END AS ref_item_no, CASE WHEN exact THEN e_cost WHEN told THEN line * 1.5::DOUBLE ELSE ref_unit_cost END AS ref_unit_cost,
CASE WHEN exact THEN e_date ELSE ref_po_order_date END AS ref_po_order_date, CASE WHEN exact THEN 100.0 WHEN told THEN round(least(100.0, 0.55 * lex + 0.45 * 80.0), 1) ELSE lex END::DOUBLE AS confidence, 'cross' AS compare_kind, CASE WHEN provenance IS NULL THEN '' ELSE 'MBL' END AS benchmark_erp_tab FROM p"""
)
def cross_match_e2e(spark, d):
    return _matched(spark, d).select("line", "item_no", "matched", "provenance", "ref_item_no", "ref_unit_cost", "ref_po_order_date", "confidence", "compare_kind", "benchmark_erp_tab")


@query(f"{_E2E} SELECT line, provenance AS match_provenance, CASE WHEN exact THEN 100.0 WHEN told THEN round(least(100.0, 0.55 * lex + 0.45 * 80.0), 1) ELSE lex END::DOUBLE AS confidence, CASE WHEN NOT exact THEN lex END::DOUBLE AS lexical, CASE WHEN told THEN 80.0 END::DOUBLE AS ai, CASE WHEN told THEN ref_item_no END AS ai_picked_item_no FROM p")
def audit_struct(spark, d):
    a = _matched(spark, d).select("line", "audit.*")
    lexical = F.when(F.col("match_provenance") != "exact_code", F.col("cross_search_lexical_confidence_pct"))
    return a.select("line", "match_provenance", F.col("cross_search_confidence_pct").alias("confidence"), lexical.alias("lexical"), F.col("cross_search_ai_confidence_pct").alias("ai"), "ai_picked_item_no")
