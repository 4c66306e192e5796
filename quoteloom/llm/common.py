"""What the operators of this folder share: tables, shared storage, joins back, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Java's spelling of the word pattern ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
#: Copies of the small side in salted_lookup(): a hot key is dealt to so many tasks.
SALTS = 16
#: Rows of a batch that Spark hands to Python, at most: with whole texts in them 10,000 are tens of MB in the JVM and in Python, a task.
BATCH_ROWS = 1000
#: Keys of a word of sieved()'s filter, about, and its words at most.
WORD_KEYS, WORDS = 8, 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, for functions that take whole texts; a smaller number stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only where nothing is set (tests on one machine) a folder below the
    warehouse is taken, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it back.

    It cuts lineage as checkpoint() does (a lost executor costs no recomputation
    of what is stored), keeps columns compressed and lets later scans prune them.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of stored() frames that only other stored() frames were made from."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Rows with their number from 0 in an order, by range partitions and their offsets: no task sees more than a range."""
    parts = stored(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return parts.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_offset") + place).select(*df.columns, name)


def row_struct(df: DataFrame) -> Column:
    """All columns of a frame, of any name, as one struct: its fields can't clash with columns that are added."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: str | Column, how: str = "left") -> DataFrame:
    """Joins rows to a table with one row a key, where a key may be on a third of all rows.

    Each row of the table is copied SALTS times and each of the rows goes to the
    copy that ``spread`` (a column that differs within a key) selects. So no task
    gets more than 1/SALTS of a hot key whether or not AQE splits skewed joins.
    Spark's estimate of the copies is that of one, so a table whose copies are
    too large for a broadcast is kept from it.
    """
    spread = F.col(spread) if isinstance(spread, str) else spread
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if SALTS * size > table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        right = right.hint("merge")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def sieved(rows: DataFrame, keys: DataFrame, key: str, into: str = "_hit") -> DataFrame:
    """Rows with the column ``into``: false where their key isn't in keys for certain, true where it may be (a join has to follow).

    keys (a stored() frame with the column ``key``) become a Bloom filter of
    three bits a key in one 64-bit word, WORD_KEYS keys a word; the table of its
    words is broadcast, so that rows that no key can match, with their texts,
    need no shuffle. It has WORDS rows at most: a fuller one lets more rows pass.
    """
    words = min(WORDS, keys.count() // WORD_KEYS + 1)
    bit = lambda by: f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{key}`, 1), {by}) & 63 as int))"
    own = [F.pmod(F.xxhash64(key), F.lit(words)).alias("_word"), F.expr(f"{bit(0)} | {bit(6)} | {bit(12)}").alias("_bits")]
    table = keys.select(*own).groupBy("_word").agg(F.bit_or("_bits").alias("_mask"))
    out = rows.select("*", *own).join(F.broadcast(table), "_word", "left")
    return out.withColumn(into, F.coalesce(F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))).drop("_word", "_bits", "_mask")


def _stars(edges: DataFrame) -> bool:
    """Whether each node has either one edge to a smaller node or none."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a long, b long): (node, component), component the smallest node.

    Alternating large-star and small-star steps. Each is a minimum a node
    (combined before the shuffle) and a join back; every round is stored, and it
    ends when all edges lead to a smallest node. Nothing but that answer reaches
    the driver. Nodes that have no edge to another node aren't returned.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_lookup(both.where("b > a"), low, "a", "b", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_lookup(large, low, "a", "b", "inner")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        last, edges = edges, stored(small.distinct())
        release(last)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select("b", "b").distinct().toDF("node", "component"))
    out._stored_at = edges._stored_at
    return out
