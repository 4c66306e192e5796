"""Mixing sources to target weights by pivotal dependent rounding (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, numbered, row_struct, salted_lookup, stored

#: Rows that one node of the reduction tree combines, on average.
FAN_IN = 256
#: Largest number of copies of a document.
MAX_COPIES = 3
SEED = 20240229


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = MAX_COPIES) -> DataFrame:
    """Water-filling: (source, source_size, nodes) -> the same with target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``cap`` times its source's size and the excess
    is shared again by weight. The fixed point is target = min(cap * size,
    level * weight): each round sums what the full sources hold and shares the
    rest among the others, until no further one is full. Sources may be many
    (web hosts): they are numbered without a single task, and a round brings
    three sums to the driver.
    """
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = numbered(sources, F.col("source").asc_nulls_last(), "number").withColumn("w", F.element_at(ws, (F.pmod(F.col("number"), F.lit(len(weights))) + 1).cast("int"))).drop("number")
    s = s.withColumn("room", F.col("source_size") * F.lit(cap))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        is_full = F.lit(False) if level is None else F.col("room") <= F.col("w") * F.lit(level)
        n, held, open_ = s.agg(F.count(F.when(is_full, 1)), F.sum(F.when(is_full, F.col("room"))), F.sum(F.when(~is_full, F.col("w")))).first()
        if n == full or not open_:
            break
        full, level = n, (total - (held or 0)) / open_
    target = F.col("room").cast("double") if level is None else F.least(F.col("room").cast("double"), F.col("w") * F.lit(level))
    return s.select("source", "source_size", "nodes", target.alias("target"))


#: One node of the tree. Its items come with the largest first; s is the one that is still fractional
#: and meets x. Words move between them until one is 0 or 1: hi is s's probability if x gives all it
#: can, lo if it takes all it can. rest and cap are the words that the items after x hold and could
#: hold; slack tells of each outcome whether what then is fractional can still get to 1 or to 0 with
#: them. If both can, chance decides; if one, it is taken, so that no long document is left over; if
#: none, chance decides but at the root, where the one that comes nearer is taken.
def _let(name: str, value: str, body: str) -> str:
    """SQL has no let: an array of one value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _outcome(v: str) -> str:
    """What remains fractional if s gets the probability v: s itself, or x if v is 0 or 1."""
    whole = f"({v} <= 1e-9 OR {v} >= 1 - 1e-9)"
    y = f"least(1D, greatest(0D, (m.mass - {v} * s.size) / x.size))"
    left = f"named_struct('v', {v}, 'y', {y}, 'whole', {whole}, 'size', IF({whole}, x.size, s.size), 'p', IF({whole}, {y}, {v}))"
    slack = "IF(o.p <= 1e-9 OR o.p >= 1 - 1e-9, 0D, greatest(o.p * o.size + m.rest - o.size, m.cap - o.p * o.size))"
    return _let("o", left, f"named_struct('o', o, 'slack', {slack})")


_CHOICE = """CASE
  WHEN a.o.v - b.o.v <= 1e-12 THEN a.o
  WHEN (a.slack >= -1e-6) <> (b.slack >= -1e-6) THEN IF(a.slack >= -1e-6, a.o, b.o)
  WHEN a.slack < -1e-6 AND nodes <= 1 THEN IF(a.slack >= b.slack, a.o, b.o)
  WHEN m.u < (s.p - b.o.v) / (a.o.v - b.o.v) THEN a.o
  ELSE b.o END"""
_NEXT = """named_struct(
  'done', array_append(s.done, IF(c.whole, named_struct('row', s.row, 'copy', cast(round(c.v) as int), 'size', s.size), named_struct('row', x.row, 'copy', cast(round(c.y) as int), 'size', x.size))),
  'row', IF(c.whole, x.row, s.row), 'id', IF(c.whole, x.id, s.id), 'size', c.size, 'p', c.p, 'rest', m.rest, 'cap', m.cap)"""
_MEET = _let("a", _outcome("least(1D, m.mass / s.size)"), _let("b", _outcome("greatest(0D, (m.mass - x.size) / s.size)"), _let("c", _CHOICE, _NEXT)))
_PIVOT = f"""
aggregate(
  reverse(array_sort(items)),
  named_struct('done', cast(array() as array<struct<row:bigint,copy:int,size:bigint>>), 'row', cast(null as bigint), 'id', cast(null as bigint), 'size', 0L, 'p', 0D,
    'rest', aggregate(items, 0D, (t, x) -> t + x.p * x.size), 'cap', aggregate(items, 0L, (t, x) -> t + x.size)),
  (s, x) -> CASE
    WHEN s.row IS NULL THEN named_struct('done', s.done, 'row', x.row, 'id', x.id, 'size', x.size, 'p', x.p, 'rest', s.rest - x.p * x.size, 'cap', s.cap - x.size)
    ELSE {_let("m", "named_struct('mass', s.p * s.size + x.p * x.size, 'rest', s.rest - x.p * x.size, 'cap', s.cap - x.size, 'u', pmod(xxhash64(s.id, s.size, x.id, x.size, {level}, {seed}), 9007199254740992) / 9007199254740992D)", _MEET)}
  END)
"""


#: What a root does last: the document that is still fractional goes to the nearer end, and single
#: copies are flipped as long as that brings the source's words nearer to its target.
_FLIPS = 8
_BEST = "array_min(transform(t.d, (z, i) -> named_struct('e', abs(t.err + IF(z.copy = 1, -z.size, z.size)), 'i', i)))"
_FLIP = """IF(b.e < abs(t.err) - 1e-6, named_struct(
  'd', transform(t.d, (z, i) -> IF(i = b.i, named_struct('row', z.row, 'copy', 1 - z.copy, 'size', z.size), z)),
  'err', t.err + IF(t.d[b.i].copy = 1, -t.d[b.i].size, t.d[b.i].size)), t)"""
_SETTLE = f"""IF(nodes > 1, s.done, aggregate(
  sequence(1, {_FLIPS}),
  named_struct('d', array_append(s.done, named_struct('row', s.row, 'copy', IF(s.p >= 0.5, 1, 0), 'size', s.size)), 'err', IF(s.p >= 0.5, 1 - s.p, -s.p) * s.size),
  (t, k) -> {_let("b", _BEST, _FLIP)}, t -> t.d))"""


def pivotal_round(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, nodes long, row long, id long, size long > 0, p double in (0,1)) -> (row, copy int).

    Each step pairs two fractional probabilities and moves words between them
    (the sum of p * size stays as it is) at random, so that both keep their
    expectation, until one of them is 0 or 1; see _PIVOT for the documents that
    could end in one way only. A node of the tree meets about FAN_IN documents
    of a source, the largest first, so that what stays fractional is a short
    one. It goes to the next level, where about FAN_IN such residuals of a
    source meet; the last one of a source is rounded, see _SETTLE.
    ``nodes`` is the source's number of leaves; a node is a hash of the id, so a
    source with a third of all rows is dealt to as many nodes as it needs.
    ``row`` is a row's identity; chance depends on id, size and seed alone, and
    ids of equal rows differ (_told_apart()).
    """
    done = None
    level = 0
    while True:
        node = F.pmod(F.xxhash64("id", F.lit(level), F.lit(seed)), F.col("nodes"))
        grouped = rows.groupBy("source", "nodes", node.alias("node")).agg(F.collect_list(F.struct("size", "id", "row", "p")).alias("items"))
        out = stored(grouped.select("source", "nodes", F.expr(_PIVOT.format(level=level, seed=seed)).alias("s")).select("source", "nodes", "s", F.expr(_SETTLE).alias("done")))
        left = out.where("nodes > 1").select("source", "nodes", "s.row", "s.id", "s.size", "s.p")
        whole = (F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9)
        part = out.select(F.inline("done")).select("row", "copy").unionByName(left.where(whole).select("row", F.round("p").cast("int").alias("copy")))
        done = part if done is None else done.unionByName(part)
        if (out.agg(F.max("nodes")).first()[0] or 1) <= 1:
            return done
        rows = left.where(~whole).withColumn("nodes", F.ceil(F.col("nodes") / FAN_IN))
        level += 1


def _key(doc_id: Column, text: Column, source: Column) -> Column:
    """128 bits of what a row is told by, the same in any reading."""
    return F.unhex(F.md5(F.concat_ws("\x00", *[F.coalesce(c.cast("string"), F.lit("\x01")) for c in (source, doc_id, text)])))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows (row, key, ...) with ``id`` for key: a hash of the key and, for rows that are equal, of their number among these.

    Equal rows may be a third of all: they are numbered by ranges of (key, row),
    so that they go to as many nodes, and no task, meets all of them.
    """
    again = stored(rows.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("many")))
    if not again.limit(1).count():
        return rows.withColumn("id", F.xxhash64("key")).drop("key")
    rows = stored(rows)
    many = numbered(salted_lookup(rows.select("key", "row"), again, "key", "row", "inner").select("key", "row"), F.struct("key", "row"), "number")
    first = many.groupBy("key").agg(F.min("number").alias("first"))
    place = salted_lookup(many, first, "key", "row", "inner").select("row", (F.col("number") - F.col("first")).alias("place"))
    own = F.when(F.coalesce("place", F.lit(0)) == 0, F.xxhash64("key")).otherwise(F.xxhash64("key", "place"))
    return rows.join(place, "row", "left").withColumn("id", own).drop("key", "place")


def _mixed(docs: DataFrame, weights: tuple[float, ...], cap: int, seed: int) -> DataFrame:
    """doc_id, key, size, source_size, target, copies of each row."""
    sized = docs.select("doc_id", "source", _key(F.col("doc_id"), F.col("text"), F.col("source")).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stored(sized.withColumn("row", F.monotonically_increasing_id()))  # stored with the rows, so it stays what it is
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / FAN_IN).alias("nodes"))
    targets = stored(source_targets(sizes, weights, cap))
    keyed = lambda df: df.withColumn("k", F.struct(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none")))
    rows = salted_lookup(keyed(sized), keyed(targets).drop("source"), "k", "row").drop("k")
    rows = rows.withColumn("want", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("sure", F.floor(F.col("want") + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("want") - F.col("sure")))
    rounded = pivotal_round(_told_apart(rows.where("p > 1e-12").select("source", "nodes", "row", "key", "size", "p")), seed)
    return rows.join(rounded, "row", "left").withColumn("copies", (F.col("sure") + F.coalesce("copy", F.lit(0))).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of docs (doc_id, text, source).

    Size is the number of words of the whole text, however long (null: 0). A
    row's expected copies are target / source_size; the whole part is certain,
    the fraction is rounded by pivotal_round(). Rows without words are never
    fractional and take 0. Repeated rows, doc_ids and null doc_ids are rows of
    their own; documents of one size tie by a hash of what they hold. An empty
    table gives an empty result. Only doc_id, text and source are read, so other
    columns of any name do no harm. The same rows give the same result.
    """
    return _mixed(docs, weights, cap, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def keep_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns of any name, each as often as the mix takes it.

    Rows that agree in doc_id, text and source are one row that is taken as
    often as all of them together. Rows without words go, as the mix takes 0 of
    them. An empty table gives an empty result.
    """
    taken = stored(_mixed(docs, (1.0, 2.0, 3.0), MAX_COPIES, SEED).groupBy("key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0"))
    rows = docs.select(_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("key"), row_struct(docs).alias("_row")).join(taken.hint("merge"), "key")
    if taken.where("_rows > 1").limit(1).count():
        once = rows.where("_rows > 1").groupBy("key").agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies"))
        rows = rows.where("_rows = 1").select("key", "_row", "_copies").unionByName(once)
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_k")).select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: mixes all documents."""
    return mix(documents(spark, sf_dir))
