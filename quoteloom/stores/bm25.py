"""A BM25 index on shared storage that follows changing documents by signed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.retrieval import FLOOR
from ..session import cut
from .snapshots import SnapshotTable

_TERMS = "array<struct<term:string,tf:long>>"


class Bm25Store:
    """Documents as signed rows (doc, fp, dl, terms, sign) and the changes of the statistics that they make.

    A document is known by its id and the hash of its text. ensure() adds a row
    of sign 1 for each new text, and one of sign -1, out of the stored row, for
    each that is gone or has changed; df, document count and total length change by the
    sums of these rows. A commit publishes both at once, and only on the
    snapshot that it was made against: of two writers the second starts again. So a tenth
    changed costs a tenth of the tokenising, and scores are those of a rebuild.
    """

    DOCS = f"doc long, fp string, dl long, terms {_TERMS}, sign int"
    STATS = "term string, df long, docs long, length long"

    def __init__(self, spark: SparkSession, folder: str, toks: Callable[[Column], Column] = T.tokens):
        self.spark, self.toks = spark, toks
        self.docs = SnapshotTable(spark, folder, self.DOCS, ("doc", "fp"))
        self.stats = SnapshotTable(spark, folder, self.STATS, ("term",))

    @classmethod
    def fresh(cls, spark: SparkSession, toks: Callable[[Column], Column] = T.tokens) -> Bm25Store:
        """An empty store in a new folder of the shared storage."""
        return cls(spark, SnapshotTable.fresh(spark, cls.DOCS, ("doc", "fp")).folder, toks)

    def version(self) -> int:
        """Number of the newest snapshot, 0 for none."""
        return self.docs.version()

    def _folders(self, version: int) -> tuple[list[str], list[str]]:
        pairs = [f.split("|") for f in self.docs.folders(version)]
        return [d for d, _ in pairs], [s for _, s in pairs]

    def _live(self, version: int, dealt: bool = False) -> DataFrame:
        """doc, fp, dl, terms of the documents that a snapshot holds; ``dealt`` by document, as the searches read them."""
        rows = self.docs.of(self._folders(version)[0])
        rows = rows.repartition("doc") if dealt else rows
        return rows.groupBy("doc", "fp").agg(F.sum("sign").alias("n"), F.any_value("dl").alias("dl"), F.any_value("terms").alias("terms")).where("n > 0").drop("n")

    @staticmethod
    def _changes(signed: DataFrame) -> DataFrame:
        """What signed rows change: df by term, and in one row of a null term the documents and the length."""
        terms = signed.select("sign", F.explode("terms.term").alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        both = signed.agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("dl")).alias("length"))
        zero = F.lit(0).cast("long")
        return terms.select("term", "df", zero.alias("docs"), zero.alias("length")).unionByName(both.select(F.lit(None).cast("string").alias("term"), zero.alias("df"), "docs", "length"))

    def ensure(self, docs: DataFrame, text: str = "text") -> tuple[int, int]:
        """Makes the index that of docs (doc, text): (texts added, texts taken out). Of rows of one doc, one counts; null texts are empty."""
        body = F.coalesce(F.col(text), F.lit(""))
        # texts are dealt by document once; what follows keeps to that
        each = docs.select("doc", body.alias("_text")).repartition("doc").withColumn("fp", F.sha2("_text", 256))
        given = each.groupBy("doc").agg(F.max("fp").alias("fp"), F.max_by("_text", "fp").alias("_text"))
        keys = cut(docs.select("doc", F.sha2(body, 256).alias("fp")).groupBy("doc").agg(F.max("fp").alias("fp")))
        while True:
            base = self.version()
            live = cut(self._live(base).select("doc", "fp"))
            known = live.groupBy("doc").agg(F.collect_set("fp").alias("_known"))
            new = given.join(known, "doc", "left").where(~F.array_contains(F.coalesce("_known", F.array().cast("array<string>")), F.col("fp")))  # only new texts are tokenised
            each = new.select("doc", "fp", F.explode_outer(self.toks(F.col("_text"))).alias("term")).groupBy("doc", "fp", "term").agg(F.count("term").alias("tf"))
            lists = each.groupBy("doc", "fp").agg(F.sum("tf").alias("dl"), F.filter(F.array_sort(F.collect_list(F.struct("term", "tf"))), lambda t: t.term.isNotNull()).alias("terms"))
            gone = live.join(keys, ["doc", "fp"], "left_anti")
            out = self._live(base).join(gone, ["doc", "fp"], "left_semi")
            signed = lists.select("doc", "fp", "dl", "terms", F.lit(1).alias("sign")).unionByName(out.select("doc", "fp", "dl", "terms", F.lit(-1).alias("sign")))
            name, n = self.docs.write(signed)
            if not n:
                return 0, 0
            written = self.docs.of([name])
            stats, _ = self.stats.write(self._changes(written))
            if self.docs.publish(base + 1, [*self.docs.folders(base), f"{name}|{stats}"]):
                added = written.where("sign = 1").count()
                return added, n - added

    def get(self, version: int | None = None) -> dict[str, DataFrame]:
        """The index as retrieval.bm25_index() gives it, of a snapshot."""
        version = self.version() if version is None else version
        live = self._live(version, True).persist()
        stats = self.stats.of(self._folders(version)[1]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("length").alias("length"))
        total = cut(stats.where("term IS NULL").select(F.col("docs").alias("n_docs"), F.try_divide("length", "docs").alias("avgdl")))
        raw = stats.where("term IS NOT NULL AND df > 0").crossJoin(F.broadcast(total)).select("term", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("mean"))
        terms = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        postings = live.select("doc", F.explode("terms").alias("t")).select("t.term", "doc", "t.tf")
        return {"postings": postings, "lengths": live.select("doc", "dl"), "terms": terms, "totals": total}

    def compact(self) -> bool:
        """Folds a snapshot's signed rows; False if another commit came first."""
        base = self.version()
        if len(self.docs.folders(base)) < 2:
            return False
        name, _ = self.docs.write(self._live(base).select("doc", "fp", "dl", "terms", F.lit(1).alias("sign")))
        stats, _ = self.stats.write(self._changes(self.docs.of([name])))
        return self.docs.publish(base + 1, [f"{name}|{stats}"])
