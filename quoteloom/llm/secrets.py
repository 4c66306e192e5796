"""Secrets, told from examples by who owns them across the corpus (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, salted_lookup, stored

#: The base kinds in their order, each a Java pattern, the group that is measured and its least length.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Further candidates: long mixed strings. They become spans of kind ``owned`` unless they are copied examples.
OPEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A candidate of so many owners, or of so many repositories, or more is a copied example.
SHARED, WIDE = 3, 10


_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _scan(rows: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<kind>: step(state, row) -> (next state, output), over an array.

    An appended array is copied, so the outputs are gathered in blocks of the
    root of the array's size: n ** 1.5 copied references and not n ** 2.
    """
    def one(acc: Column, row: Column) -> Column:
        after, out = step(acc.s, row)
        return F.struct(after.alias("s"), F.array_append(acc.out, out.cast(kind)).alias("out"))

    def many(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc.s.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), one)
        return F.transform(F.array(got), lambda g: F.struct(g.s.alias("s"), F.array_append(acc.out, g.out).alias("out")))[0]

    def all_of(given: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(given)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(given) / block).cast("int") - 1)), lambda i: F.slice(given, i * block + 1, block))
        zero = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, zero, many, lambda acc: F.flatten(acc.out))

    return F.transform(F.array(rows), all_of)[0]  # the array is made once


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost non-overlapping matches, in code points.

    The texts between the matches (split) and the matches give all positions;
    matches whose group is too short are dropped only then, so what they have
    covered stays covered.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(F.zip_with(whole, value, lambda w, v: F.struct(w.alias("w"), v.alias("v"))), gaps, lambda m, g: F.struct(F.coalesce(F.length(m.w), F.lit(0)).alias("n"), m.v.alias("v"), F.length(g).alias("g")))
    span = lambda at, m: (at + m.g + m.n, F.struct((at + m.g).alias("start"), F.lit(kind).alias("kind"), (at + m.g + m.n).alias("end"), m.v.alias("value")))
    found = F.filter(_scan(rows, F.lit(0), _SPAN, span), lambda s: F.length(s.value) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _free(open_: Column, base: Column) -> Column:
    """The open spans that overlap no base span: one pass for the base spans that start before each, one for those that start after."""
    flag = lambda spans, b: F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(b).alias("base"), s.kind.alias("kind"), s.end.alias("end"), s.value.alias("value")))
    kind = "struct<start:int,base:int,kind:int,end:int,value:string>"
    events = F.array_sort(F.concat(flag(base, 0), flag(open_, 1)))
    reach = lambda at, s: (F.when(s.base == 0, F.greatest(at, s.end)).otherwise(at), F.when((s.base == 0) | (at <= s.start), s))
    left = F.reverse(F.filter(_scan(events, F.lit(0), kind, reach), lambda s: s.isNotNull()))
    start = lambda at, s: (F.when(s.base == 0, s.start).otherwise(at), F.when((s.base == 1) & (at >= s.end), s))
    kept = F.filter(_scan(left, F.lit((1 << 31) - 1), kind, start), lambda s: s.isNotNull())
    return F.reverse(F.transform(kept, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.value.alias("value"))))


def _joined(spans: Column, more: Callable[[Column], list[Column]] = lambda s: []) -> Column:
    names = F.array(*[F.lit(k) for k in [*BASE, "owned"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"), *more(s))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", shared: int = SHARED, wide: int = WIDE) -> DataFrame:
    """One row a row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, live_spans, n_example, n_few, n_live, verdicts.

    Candidates are the base spans and other long strings that mix letters and
    digits. The hash of each candidate's value is aggregated over the corpus by
    distinct owners and repositories. All copies of a text count as the smallest
    of their repositories, so that they count once. A value of ``shared`` owners
    or ``wide`` repositories or more is a copied example; of the others, one of a
    single owner is live-looking and one of several is ``few``. Base spans stay
    whatever they are; a further candidate that overlaps none of them becomes a
    span of kind ``owned`` unless it is an example. live_spans are the
    live-looking ones of all. verdicts has kind, start, end, verdict, owners and
    repositories of every candidate. Null texts are empty, a null owner is an
    owner of its own, and repeated rows are rows of their own that count once per
    owner. Texts are read whole, and one of very many matches takes little more
    than its share. An empty table gives an empty result. Columns other than
    doc_id, text, owner and repository aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [_spans(F.col("text"), p, g, n, k) for k, (p, g, n) in enumerate(BASE.values())]
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("\u0000")).alias("owner"), F.col(repository).cast("string").alias("repo"))
    base = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", F.xxhash64(F.sha2("text", 256)).alias("copy"), *[p.alias(k) for p, k in zip(parts, BASE, strict=True)], _spans(F.col("text"), OPEN, 0, 20, len(BASE)).alias("open"))
    base = base.withColumn("base", F.array_sort(F.concat(*BASE)))
    mixed = lambda s: s.value.rlike("[0-9]") & s.value.rlike("[a-z]") & s.value.rlike("[A-Z]")
    base = base.withColumn("open", F.filter("open", mixed))
    base = base.withColumn("open", F.when((F.size("open") == 0) | (F.size("base") == 0), F.col("open")).otherwise(_free(F.col("open"), F.col("base"))))
    slim = lambda c: F.transform(c, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), F.sha2(s.value, 256).alias("hash")))
    found = stored(base.select("row", "doc_id", "owner", "repo", "copy", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], _joined(F.col("base")).alias("base_text"), slim(F.concat("base", "open")).alias("found")))
    each = found.select("row", "owner", "repo", "copy", F.explode("found").alias("s")).select("row", "owner", "repo", "copy", "s.*")
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    texts = each.groupBy("hash", "copy").agg(F.min("repo").alias("repo"))
    repos = texts.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    known = stored(owners.join(repos, "hash").where("owners > 1 or repos > 1"))  # most values are in one text alone
    told = salted_lookup(each, known, "hash", "row").fillna(1, ["owners", "repos"])
    lists = told.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "owners", "repos")).alias("told"))
    out = found.drop("found").join(lists, "row", "left")
    told = F.coalesce("told", F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repos:bigint>>"))
    out = out.withColumn("told", F.array_sort(told))
    example = lambda s: (s.owners >= shared) | (s.repos >= wide)
    live = lambda s: ~example(s) & (s.owners == 1)
    few = lambda s: ~example(s) & (s.owners > 1)
    spans = F.filter("told", lambda s: (s.kind < len(BASE)) | ~example(s))
    verdict = lambda s: F.when(example(s), "example").when(live(s), "live").otherwise("few")
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        F.sha2(F.col("base_text"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        _joined(F.filter("told", live)).alias("live_spans"),
        *[F.size(F.filter("told", f)).cast("long").alias(f"n_{k}") for k, f in (("example", example), ("few", few), ("live", live))],
        _joined(F.col("told"), lambda s: [verdict(s), s.owners.cast("string"), s.repos.cast("string")]).alias("verdicts"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents; owners are sources, repositories are documents."""
    return scan(documents(spark, sf_dir))
