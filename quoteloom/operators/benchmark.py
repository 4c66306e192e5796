"""Price benchmarks per item and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..sources.erp import TIE


def keyed(lines: DataFrame) -> DataFrame:
    """Lines with item_key, without those that have none."""
    return lines.where(S.has_item_key(F.col("item_no"))).withColumn("item_key", S.item_key(F.col("item_no")))


def _first(lines: DataFrame, *order: Column) -> DataFrame:
    """The first line of each item in an order that TIE completes."""
    w = Window.partitionBy("item_key").orderBy(*order, *TIE)
    return lines.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest(lines: DataFrame) -> DataFrame:
    """The last line by order date; lines without date last."""
    return _first(lines, F.desc_nulls_last("po_order_date"))


def lowest(lines: DataFrame) -> DataFrame:
    """The cheapest line, the later one of equal ones."""
    return _first(lines.where("unit_cost IS NOT NULL"), F.asc("unit_cost"), F.desc_nulls_last("po_order_date"))


def before_window(lines: DataFrame, cutoff: str) -> DataFrame:
    """The last priced line before the cutoff date."""
    return _first(lines.where(F.col("unit_cost").isNotNull() & (F.col("po_order_date") < F.lit(cutoff).cast("date"))), F.desc("po_order_date"))


def window_fallback(lines: DataFrame, cutoff: str) -> DataFrame:
    """The cheapest line since the cutoff, else the last priced one before: one pass of one window."""
    inside = F.col("po_order_date") >= F.lit(cutoff).cast("date")
    rows = lines.where("unit_cost IS NOT NULL AND po_order_date IS NOT NULL").withColumn("in_window", inside)
    return _first(rows, F.desc("in_window"), F.when(F.col("in_window"), F.col("unit_cost")).asc_nulls_last(), F.desc("po_order_date"))


def cutoff(as_of: str, years: int = 2) -> Column:
    """The day so many years before."""
    return F.add_months(F.lit(as_of).cast("date"), -12 * years)


def other_vendor(lines: DataFrame, vendor: str) -> DataFrame:
    """Lines of other vendors; all of them for an empty vendor."""
    key = S.vendor_key(F.lit(vendor))
    return lines.where((key == "") | (S.vendor_key(F.col("vendor")) != key))


def same_vendor(lines: DataFrame, vendor: str) -> DataFrame:
    """Lines of one vendor; none for an empty vendor."""
    key = S.vendor_key(F.lit(vendor))
    return lines.where((key != "") & (S.vendor_key(F.col("vendor")) == key))


def exclude_po(lines: DataFrame, po_number: str) -> DataFrame:
    """Lines of other orders; an empty number excludes nothing."""
    po = po_number.strip()
    return lines if not po else lines.where(F.trim(F.coalesce("po_number", F.lit(""))) != po)


def dedupe_items(items: DataFrame) -> DataFrame:
    """The first of the input items with the same key; items without key go. Items have pos."""
    rows = items.where(S.has_item_key(F.col("item_no"))).withColumn("item_key", S.item_key(F.col("item_no")))
    w = Window.partitionBy("item_key").orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def compare(lines: DataFrame, items: DataFrame, new_po: str, vendor: str, day: str) -> DataFrame:
    """Each item (pos, item_no, description, unit, qty, new_unit_cost) against the benchmarks of its key.

    ``lines`` are keyed(). The overall benchmark gives the previous order, the
    other vendors' one the lowest price, the same vendor's one its own last. All
    come from one scan and one aggregation, whose partial results are a row an
    item and task; Spark broadcasts the items where they are few.
    """
    rows = exclude_po(lines, new_po)
    key, own = S.vendor_key(F.lit(vendor)), S.vendor_key(F.col("vendor"))
    priced = F.col("unit_cost").isNotNull() & F.col("po_order_date").isNotNull()
    inside = F.col("po_order_date") >= F.lit(day).cast("date")
    told = ("unit_cost", "unit", "po_number", "po_order_date", "vendor", "project_name", "item_description")
    # the order of window_fallback() as the order of a struct
    line = F.struct(F.when(inside, 0).otherwise(1).alias("o"), F.when(inside, F.col("unit_cost")).alias("c"), (-F.unix_date("po_order_date")).alias("d"), F.struct(*TIE).alias("tie"), F.struct(*told).alias("x"))
    flavours = {"all": priced, "low": priced & ((key == "") | (own != key)), "own": priced & (key != "") & (own == key)}
    described = F.min(F.when(S.nullable_str(F.col("item_description")) != "", F.struct("po_number", "line_no", "item_description")))
    best = rows.groupBy("item_key").agg(*[F.min(F.when(which, line)).alias(n) for n, which in flavours.items()], described.alias("described"))
    best = best.select("item_key", *[F.col(f"{n}.x.{c}").alias(f"{n}_{c}") for n in flavours for c in told], F.col("described.item_description").alias("any_description"))
    out = items.where(S.has_item_key(F.col("item_no"))).withColumn("item_key", S.item_key(F.col("item_no"))).join(best, "item_key", "left")
    low = F.col("low_unit_cost")
    qty = F.coalesce(F.col("qty"), F.lit(1.0))
    new = F.coalesce(F.col("new_unit_cost"), low)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select(
        F.col("pos").alias("id"),
        "item_no",
        "item_key",
        F.col("all_po_number").alias("previous_po_number"),
        F.lit(new_po).alias("new_po_number"),
        F.lit(vendor).alias("vendor_given"),
        S.final_description(F.col("description"), F.col("all_item_description"), F.col("any_description")).alias("description"),
        "unit",
        F.col("all_unit").alias("hist_unit_last_po"),
        S.uom_mismatch(F.col("unit"), F.col("all_unit")).alias("unit_mismatch"),
        low.alias("lowest_hist_unit_cost"),
        F.col("own_unit_cost").alias("same_vendor_latest_hist_unit_cost"),
        F.col("own_vendor").alias("same_vendor_benchmark_vendor"),
        iso(F.col("own_po_order_date")).alias("same_vendor_benchmark_po_date"),
        F.col("own_po_number").alias("same_vendor_benchmark_po_number"),
        F.col("own_project_name").alias("same_vendor_benchmark_site_name"),
        F.col("own_unit").alias("same_vendor_hist_unit"),
        F.col("low_vendor").alias("lowest_benchmark_vendor"),
        iso(F.col("low_po_order_date")).alias("lowest_benchmark_po_date"),
        F.col("low_po_number").alias("lowest_benchmark_po_number"),
        F.col("low_unit").alias("lowest_benchmark_hist_unit"),
        F.col("low_project_name").alias("lowest_benchmark_site_name"),
        new.alias("new_unit_cost"),
        qty.alias("qty"),
        (low * qty).alias("benchmark_line_cost"),
        (new * qty).alias("new_line_cost"),
        ((new - low) * qty).alias("difference_sar"),
        S.safe_pct(new, low).alias("pct_change"),
        F.col("all_vendor").alias("vendor_last"),
        iso(F.col("all_po_order_date")).alias("last_po_date"),
        F.col("all_unit_cost").isNotNull().alias("has_history"),
    )


def item_reference(lines: DataFrame, items: DataFrame, day: str) -> DataFrame:
    """For each distinct input item its benchmark line, or blanks where it has none."""
    b = window_fallback(lines, day).select("item_key", F.col("item_description").alias("hist_description"), "unit_cost", F.col("unit").alias("hist_unit"), "po_number", "po_order_date", "vendor", F.col("project_name").alias("site_name"))
    out = dedupe_items(items).join(b, "item_key", "left")
    return out.select("item_key", "item_no", S.final_description(F.col("description"), F.col("hist_description"), F.lit(None).cast("string")).alias("description"), F.col("unit_cost").alias("reference_unit_cost"), "hist_unit", "po_number", F.date_format("po_order_date", "yyyy-MM-dd").alias("po_date"), "vendor", "site_name", F.col("unit_cost").isNotNull().alias("has_history"))


def item_history(lines: DataFrame, item_no: str) -> DataFrame:
    """All lines of one item, the newest first (by date, then order number); pos gives the order."""
    rows = lines.where(F.col("item_key") == S.item_key(F.lit(item_no)))
    w = Window.partitionBy("item_key").orderBy(F.desc_nulls_last("po_order_date"), F.desc_nulls_last("po_number"), *TIE)
    return rows.select(F.row_number().over(w).alias("pos"), "item_key", "po_number", F.date_format("po_order_date", "yyyy-MM-dd").alias("po_date"), "vendor", "unit_cost", "unit", "qty", "project_name")


def order_lines(lines: DataFrame, po_number: str) -> DataFrame:
    """The lines of one order by date and item; pos gives the order."""
    rows = lines.where(S.po_key(F.col("po_number")) == S.po_key(F.lit(po_number)))
    w = Window.partitionBy(S.po_key(F.col("po_number"))).orderBy(F.desc_nulls_last("po_order_date"), F.asc_nulls_last("item_no"), *TIE)
    return rows.select(F.row_number().over(w).alias("pos"), "po_number", "item_no", "item_description", S.fmt_cell_num(F.col("qty")).alias("qty"), "unit", "unit_cost", (F.col("unit_cost") * F.col("qty")).alias("line_cost"), F.date_format("po_order_date", "yyyy-MM-dd").alias("po_date"), "vendor", "project_name")


def dominant(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """key -> its most frequent non-blank value; of equal ones the one seen first."""
    seen = rows.where(S.nullable_str(F.col(value)) != "").groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first", value)
    return seen.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col(value).alias(f"dominant_{value}"), F.col("n").alias(f"n_{value}"))


def prefill(lines: DataFrame) -> DataFrame:
    """For each order its dominant vendor and project, its first date and its number of lines."""
    base = lines.groupBy("po_number").agg(F.min("po_order_date").alias("po_date"), F.count("*").alias("n_lines"))
    for c in ("vendor", "project_name"):
        base = base.join(dominant(lines, "po_number", c, "line_no", "item_no", "qty"), "po_number", "left")
    return base
