"""Scalar normalisers and parsers as native column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Zero-width characters that identifiers lose.
ZERO_WIDTH = "﻿​‌‍⁠"
#: Excel serial days that count as dates.
SERIAL_LOW, SERIAL_HIGH = 29_500, 65_000
#: Company suffixes, each tested once, in this order.
VENDOR_SUFFIXES = (" CO.", " CO", " COMPANY", " LTD", " LLC", " EST.", " EST", " ESTABLISHMENT", " CORP", " CORPORATION", " INC", " W.L.L", " WLL")
#: Texts that stand for no description.
PLACEHOLDERS = ("non", "n/a", "na", "none", "tbd", "-", "--", ".", "…")
_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility folding; ASCII passes through."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def clean_item_no(c: Column, fold: bool = False) -> Column:
    """Zero-width characters go, no-break spaces become spaces, white space is squeezed; fold adds NFKC."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = nfkc(c) if fold else c
    return squeeze(F.regexp_replace(F.regexp_replace(c, f"[{ZERO_WIDTH}]", ""), " ", " "))


def _item_form(t: Column) -> Column:
    """``12.0`` is ``12``, NaN is empty, upper case; of squeezed text."""
    return F.upper(F.regexp_replace(F.regexp_replace(t, "(?i)^nan$", ""), r"^(\d+)\.0+$", "$1"))


def normalize_item_no(c: Column) -> Column:
    """``12.0`` is ``12``; white space squeezed; upper case; null and NaN are empty."""
    return _item_form(squeeze(F.coalesce(c.cast("string"), F.lit(""))))


def item_key(c: Column, fold: bool = False) -> Column:
    """The key that input items and history meet on: normalize_item_no() of clean_item_no(), in few steps so that generated code stays small."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    if fold:
        return normalize_item_no(clean_item_no(c, True))
    t = F.regexp_replace(t, rf"(?U)[{ZERO_WIDTH}]+|^[\s{ZERO_WIDTH}]+|[\s{ZERO_WIDTH}]+$", "")
    return _item_form(F.regexp_replace(t, r"(?U)\s+", " "))


def has_item_key(c: Column) -> Column:
    """Whether item_key() isn't empty: what a filter below the joins looks at."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return t.rlike(rf"(?U)[^\s{ZERO_WIDTH}]") & ~t.rlike(rf"(?iU)^[\s{ZERO_WIDTH}]*n[{ZERO_WIDTH}]*a[{ZERO_WIDTH}]*n[\s{ZERO_WIDTH}]*$")


def po_key(c: Column) -> Column:
    """As item_key, and numbers within 1e-9 of an integer are that integer."""
    t = squeeze(F.coalesce(c.cast("string"), F.lit("")))
    n = plain_double(t)
    whole = n.isNotNull() & t.contains(".") & (F.abs(n - F.round(n)) < 1e-9) & (F.abs(n) < 1e15)
    return F.upper(F.when(whole, F.round(n).cast("long").cast("string")).otherwise(t))


def uom_key(c: Column) -> Column:
    """Unit of measure: upper case without dots and spaces; P/H is PH."""
    t = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), ". ", "")
    return F.when(t == "P/H", "PH").otherwise(t)


def uom_mismatch(a: Column, b: Column) -> Column:
    """Whether two units are both given and differ."""
    a, b = uom_key(a), uom_key(b)
    return (a != "") & (b != "") & (a != b)


def vendor_key(c: Column) -> Column:
    """Upper case, trimmed, tabs and line breaks as spaces."""
    return F.upper(F.trim(F.translate(F.coalesce(c, F.lit("")), "\t\n\r", "   ")))


def vendor_key_local(c: Column) -> Column:
    """Vendor without company suffixes and anything but A-Z and 0-9."""
    name = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"(?:\r\n|[\n\r\u0085\u2028\u2029])$", "")
    suffixes = F.array(*[F.lit(x) for x in VENDOR_SUFFIXES])
    cut = lambda t, x: F.when(F.endswith(t, x), F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(x)))).otherwise(t)
    return F.regexp_replace(F.aggregate(suffixes, name, cut), "[^A-Z0-9]", "")


def plain_double(c: Column) -> Column:
    """A double from ordinary notation only (no NaN, Infinity or type suffixes)."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def clean_numeric(c: Column) -> Column:
    """Digits, comma, dot and minus; with both, commas group; a lone comma is the decimal sign."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9,.\-]", "")
    both = t.contains(",") & t.contains(".")
    return plain_double(F.when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit("."))))


def nullable_float(c: Column) -> Column:
    """Digits, dot and minus; commas always group."""
    return plain_double(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9.\-]", ""))


def unit_cost_scalar(c: Column) -> Column:
    """Price without currency, commas and spaces; else the first number in it."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(s, r"(?i)SAR|USD|EUR|ر\.س|[,\s]", "")
    first = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1)
    return F.coalesce(plain_double(t), plain_double(first), clean_numeric(s))


def _written_date(s: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MMM-yyyy")])


def po_date(c: Column) -> Column:
    """The column rule: a date from an Excel serial, a number or text, or a written date; other bare numbers are null."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    n = plain_double(s)
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))
    return F.when(n.isNotNull(), F.when(n.between(SERIAL_LOW, SERIAL_HIGH), serial)).otherwise(_written_date(s))


def po_date_cell(c: Column, kind: str = "string") -> Column:
    """The cell rule: only a cell of a numeric type is an Excel serial; text is a written date or null."""
    if kind in ("double", "float", "int", "bigint", "long"):
        return po_date(c)
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(plain_double(s).isNull(), _written_date(s))


def po_date_iso(c: Column) -> Column:
    """po_date as yyyy-MM-dd text."""
    return F.date_format(po_date(c), "yyyy-MM-dd")


def nullable_str(c: Column) -> Column:
    """Trimmed text, null as empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def dict_first(m: Column, *keys: str) -> Column:
    """The first key of a map with a non-empty value, else the same without regard to case."""
    low = F.transform_keys(m, lambda k, _: F.lower(k))
    exact = [F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys]
    return F.coalesce(*exact, *[F.nullif(F.try_element_at(low, F.lit(k.lower())), F.lit("")) for k in keys])


def final_description(given: Column, benchmark: Column, history: Column) -> Column:
    """The first non-empty of three, else ``non``."""
    return F.coalesce(*[F.nullif(nullable_str(c), F.lit("")) for c in (given, benchmark, history)], F.lit("non"))


def fmt_cell_num(c: Column) -> Column:
    """Integral numbers without decimals, others with six at most; nothing for non-finite ones."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "").otherwise(F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(text))


def placeholder_to_empty(c: Column) -> Column:
    """Descriptions of under three characters or that stand for none become empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when((F.length(t) < 3) | F.lower(t).isin(*PLACEHOLDERS), "").otherwise(t)


def cap_text(c: Column, limit: int, suffix: str = "") -> Column:
    """Text cut at a limit, with a suffix where it was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def company_tab(c: Column) -> Column:
    """One of MBL, IFAS, MSB; anything else is MBL."""
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("IFAS", "MBL", "MSB"), t).otherwise("MBL")


def blend_confidence(lexical: Column, model: Column) -> Column:
    """0.55 lexical + 0.45 model, at most 100, one decimal; the one that is there; else null."""
    both = F.round(F.least(F.lit(100.0), 0.55 * lexical + 0.45 * model), 1)
    only = F.coalesce(lexical, model)
    return F.when(lexical.isNotNull() & model.isNotNull(), both).when(only.isNotNull(), F.round(F.least(F.lit(100.0), only), 1))


def confidence_pct(c: Column) -> Column:
    """0..1 as a percentage, 1..100 as it is, else null."""
    return F.when(c.between(0, 1), c * 100).when((c > 1) & (c <= 100), c)


def matched_flag(c: Column) -> Column:
    """true/1/yes, false/0/no, else null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def json_loose(c: Column) -> Column:
    """The JSON object of a text: the whole, a fenced block or the outer braces, as text; else null."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t)
    return F.coalesce(*[valid(F.trim(t)) for t in (c, fenced, outer)])


def company_slug(c: Column) -> Column:
    """Lower-case letters and digits, others as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_|_$", "")


def safe_pct(new: Column, low: Column) -> Column:
    """(new - low) / low * 100, null for a low of 0."""
    return F.when(low != 0, (new - low) / low * 100)
