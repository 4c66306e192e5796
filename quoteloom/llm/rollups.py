"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_folder, stored

KEY = ("source", "lang", "tokenizer")
#: Characters of tables and junk that the revised texts of poor documents lose.
JUNK = "#*$%&|<>"
_COUNTED = "doc_id long, source string, lang string, tokenizer string, tokens long, revised long"
_drop = str.maketrans("", "", JUNK)


def _bpe(path: str | None = None) -> Callable[[str], int]:
    from .tokens import encoder

    enc = encoder(path)
    return lambda t: len(enc.encode(t))


def _multi(path: str | None = None) -> Callable[[str], int]:
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t.encode("utf-8", "replace").decode()))


#: Tokenizer version -> what makes its counter in a worker; the files are those of the public tokenizers installed on each machine.
TOKENIZERS: dict[str, Callable[[], Callable[[str], int]]] = {"byte_bpe_50k/1": _bpe, "byte_bpe_multi_50k/1": _multi}


def counts(docs: DataFrame, tokenizers: dict[str, Callable] = TOKENIZERS) -> DataFrame:
    """docs (doc_id, source, lang, text) -> doc_id, source, lang, tokenizer, tokens, revised: a row a document and version.

    ``revised`` is the count of the text without JUNK characters. One scan, in
    which each text is read once; null texts count as empty, whole texts count
    however long, repeated rows are rows of their own and other columns aren't
    read.
    """

    def run(batches):
        made = {n: make() for n, make in tokenizers.items()}
        for b in batches:
            out: list[list] = [[], [], []]
            for t in b.column("text"):
                text = t.as_py() or ""
                clean = text.translate(_drop) if any(c in text for c in JUNK) else text
                for name, count in made.items():
                    n = count(text)
                    for column, v in zip(out, (name, n, n if clean is text else count(clean)), strict=True):
                        column.append(v)
            at = pa.array([i for i in range(b.num_rows) for _ in made], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("doc_id", "source", "lang")), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["doc_id", "source", "lang", "tokenizer", "tokens", "revised"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, _COUNTED)


def _signed(counted: DataFrame, docs: int, tokens: str) -> DataFrame:
    return counted.select(*KEY, F.lit(docs).cast("long").alias("docs"), F.expr(tokens).cast("long").alias("tokens"))


def inserts(counted: DataFrame) -> DataFrame:
    """Signed rows for new documents: counted has source, lang, tokenizer, tokens."""
    return _signed(counted, 1, "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    """Signed rows for removed documents."""
    return _signed(counted, -1, "-tokens")


def revisions(counted: DataFrame) -> DataFrame:
    """Signed rows for counts that ``revised`` replaces."""
    return _signed(counted, 0, "revised - tokens")


class Rollup:
    """Totals of documents and tokens by source, lang and tokenizer version in a folder.

    A batch is the sum of its signed rows by key (null keys are keys), written to
    ``rows/batch=<id>/attempt=<new name>``. The commit is the rename of a marker
    to ``commits/<id>``, which fails if that file is there: of several writers of
    one id, one wins, and readers take that attempt's rows alone. So a retry or a
    repeated delivery changes nothing and a run that dies leaves rows that nobody
    reads. The file system has to rename atomically without overwriting (HDFS
    does). Totals are the sum over the committed batches in any order. compact()
    folds exactly the batches of one reading of the commits into an epoch; later
    ones are added to it.
    """

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch string, attempt string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._fs_of = jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._context = self._fs_of.FileContext.getFileContext(self._path("").toUri(), conf)

    def _path(self, name: str):
        return self._fs_of.Path(f"{self.folder}/{name}" if name else self.folder)

    def _publish(self, name: str, content: str) -> bool:
        """Puts a small file in place, whole or not at all; False if one of that name is there."""
        draft = self._path(f"_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(content.encode()))
        out.close()
        self._fs.mkdirs(self._path(name).getParent())
        none = self.spark.sparkContext._gateway.new_array(self._fs_of.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(name), none)
        except Py4JJavaError as e:
            if not self._fs.exists(self._path(name)):
                raise
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def committed(self, batch_id: str) -> bool:
        """Whether a batch is in, folded or not."""
        return bool(self._fs.exists(self._path(f"commits/{batch_id}")))

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Adds a batch; False if it is committed already, by whom ever."""
        if not batch_id or not all(c.isalnum() or c in "-." for c in batch_id) or batch_id.startswith("."):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        attempt = uuid.uuid4().hex
        sums = events.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.folder}/rows/batch={batch_id}/attempt={attempt}")
        return self._publish(f"commits/{batch_id}", attempt)

    def _commits(self) -> DataFrame:
        if not self._fs.exists(self._path("commits")):
            return self.spark.createDataFrame([], "batch string, attempt string")
        return self.spark.read.text(f"{self.folder}/commits").select(F.col("_metadata.file_name").alias("batch"), F.col("value").alias("attempt"))

    def _epoch(self) -> str | None:
        """Folder of the newest epoch."""
        p = self._path("epochs")
        names = [int(s.getPath().getName()) for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return self.spark.read.text(f"{self.folder}/epochs/{max(names)}").first()[0] if names else None

    def _state(self, commits: DataFrame, epoch: str | None) -> DataFrame:
        """Signed rows of the epoch and of those commits that it hasn't folded."""
        new = commits if epoch is None else commits.join(self.spark.read.schema("batch string").parquet(f"{self.folder}/{epoch}/folded"), "batch", "left_anti")
        out = self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        if self._fs.exists(self._path("rows")):
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/rows")
            out = out.unionByName(rows.join(new, ["batch", "attempt"], "left_semi").select(*KEY, "docs", "tokens"))
        return out if epoch is None else out.unionByName(self.spark.read.schema(out.schema).parquet(f"{self.folder}/{epoch}/sums"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the keys that have any."""
        out = self._state(self._commits(), self._epoch()).groupBy(*KEY).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Folds the batches committed so far; False if another compaction was first. What is folded stays for readers until vacuum()."""
        p = self._path("epochs")
        number = max([int(s.getPath().getName()) for s in self._fs.listStatus(p)], default=0) + 1 if self._fs.exists(p) else 1
        epoch, folder = self._epoch(), f"folds/{number}-{uuid.uuid4().hex}"
        commits = stored(self._commits())  # one reading: what is folded and what is noted as folded are the same
        self._state(commits, epoch).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.folder}/{folder}/sums")
        commits.select("batch").write.parquet(f"{self.folder}/{folder}/folded")
        return self._publish(f"epochs/{number}", folder)

    def vacuum(self) -> None:
        """Deletes the rows of folded batches. For times when nobody reads an older state."""
        epoch = self._epoch()
        if epoch is None:
            return
        for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/{epoch}/folded").toLocalIterator():
            self._fs.delete(self._path(f"rows/batch={r['batch']}"), True)


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents are inserted under two tokenizer versions, toxic ones deleted, and low-quality ones' byte_bpe_50k counts revised; one batch comes twice.

    Texts are read in one scan and never shuffled: the labels meet slim rows of
    counts. Null and empty texts have no tokens but count as documents; null
    sources and languages are keys; labels that come twice count as toxic if any
    is and as poor if any is; rows without doc_id have no label. Empty tables
    give an empty result, and columns other than doc_id, text, source and lang
    aren't read.
    """
    counted = stored(counts(documents(spark, sf_dir)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rollup = Rollup(spark, shared_folder(spark))
    for name in TOKENIZERS:
        rollup.commit(f"load-{name.replace('/', '-').replace('_', '-')}", inserts(counted.where(F.col("tokenizer") == name)))
    pick = lambda which: counted.join(labels.where(which).select("doc_id").hint("merge"), "doc_id", "left_semi")
    takedown = deletes(pick("toxic = 1"))
    rollup.commit("takedown", takedown)
    rollup.compact()
    poor = pick("coalesce(toxic, 0) <> 1 AND quality = 0").where(F.col("tokenizer") == next(iter(TOKENIZERS)))
    rollup.commit("recount", revisions(poor))
    rollup.commit("takedown", takedown)
    return rollup.totals()
