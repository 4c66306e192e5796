"""Language identification by the nearest TF-IDF centroid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import bounded_batches, documents, release, row_struct, stored

#: Hashed dimensions of the n-gram vectors.
DIMS = 1 << 12
#: Byte n-grams of these lengths.
ORDERS = (1, 2, 3)
#: Centroids a language.
CENTROIDS = 4
#: Labelled documents a language that the centroids are fitted on, at most. The bound of the model's sample.
SAMPLE = 500
#: Languages that a model may have; more raise an error, so none is left out unseen. Bounds the model at 64 KB a language.
LANGUAGES = 10_000
#: A document whose best cosine is below this share of the lowest one seen in its language's sample is rejected.
SLACK = 0.5

_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters count as one space.
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed byte n-gram counts of a whole lower-cased text, in blocks."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" "
    out = np.zeros(DIMS)
    step = 1 << 20
    for at in range(0, len(raw), step):
        data = np.frombuffer(raw[at : at + step + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        own = min(step, len(raw) - at)
        key = np.zeros(len(data), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            key = (key[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
            if n in ORDERS:
                hashed = ((key[:own] ^ np.uint32(n * 0x1000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
                out += np.bincount(hashed, minlength=DIMS)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector with sublinear term frequencies."""
    v = np.log1p(counts(text)) * idf
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


@dataclass
class Model:
    """Centroids (rows of unit length), their language and the cosine that each language rejects below."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or ``und``, score 0..1, rejected)."""
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        v = vector(text, self.idf)
        cos = self.centroids @ v
        best = int(cos.argmax())
        mine = self.owner[best]
        score = float(min(1.0, max(0.0, cos[best])))
        return self.languages[mine], score, bool(cos[best] < self.floor[mine])


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic."""
    first = int((x @ x.mean(0)).argmax())
    seeds = [first]
    near = x @ x[first]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, h, text in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
            c = counts(text)
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "h": pa.array([h], pa.int64()), "at": pa.array([at.tolist()], pa.list_(pa.int32())), "n": pa.array([c[at].tolist()], pa.list_(pa.float64()))})


def _centroids(idf: np.ndarray, k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        x = np.zeros((table.num_rows, DIMS), np.float32)
        for i, (at, n) in enumerate(zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True)):
            x[i, at] = n
        x = np.log1p(x) * idf.astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _clusters(x, k).astype(np.float32)
        floor = SLACK * float((x @ c.T).max(1).min())
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(c), "k": pa.array(range(len(c)), pa.int32()), "c": pa.array(c.tolist(), pa.list_(pa.float32())), "floor": [floor] * len(c)})

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Model:
    """Fits centroids on at most ``sample`` distinct rows of each lang of (doc_id, text, lang).

    The rows with the lowest hashes of doc_id and text are taken, so the sample
    doesn't depend on the order of the input; its size doesn't grow with it. Each
    language's vectors meet in one task, ``sample`` of DIMS entries; the driver
    sees the centroids and the document frequencies of the dimensions. More than
    ``languages`` languages raise ValueError.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    if sizes.count() > languages:
        raise ValueError(f"more than {languages} languages")
    unit = F.col("h") / F.lit(float(1 << 64)) + 0.5
    # about 4 x sample rows of a language meet in one task, however many it has
    few = rows.select("lang", "h").join(F.broadcast(sizes), "lang").where(unit * F.col("rows") < 4 * sample).select("lang", "h").distinct()
    chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)
    cuts = chosen.groupBy("lang").agg(F.max("h").alias("cut"))
    texts = rows.join(F.broadcast(cuts), "lang").where("h <= cut").select("lang", "h", "text").dropDuplicates(["lang", "h"])
    got = stored(texts.mapInArrow(_features, "lang string, h long, at array<int>, n array<double>"))
    seen = {r["at"]: r["count"] for r in got.select(F.explode("at").alias("at")).groupBy("at").count().collect()}
    df = np.array([seen.get(i, 0) for i in range(DIMS)], float)
    idf = np.log((1 + got.count()) / (1 + df)) + 1.0
    found = got.groupBy("lang").applyInArrow(_centroids(idf, centroids), "lang string, k int, c array<float>, floor double").collect()
    found.sort(key=lambda r: (r["lang"], r["k"]))
    release(sizes, got)
    names = sorted({r["lang"] for r in found})
    owner = np.array([names.index(r["lang"]) for r in found], int)
    floor = np.array([next(r["floor"] for r in found if r["lang"] == n) for n in names])
    return Model(names, owner, np.array([r["c"] for r in found], np.float32).reshape(-1, DIMS), idf, floor)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs (doc_id, text).

    Null texts and texts without a letter are ``und``, score 0 and rejected; a
    text far from all centroids keeps the nearest language and is rejected.
    Without any learned language all are ``und``. Ties go to the first centroid
    in the order of language names. The whole text counts. Other columns aren't
    read.
    """

    def run(batches):
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            got = [model.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that identify() doesn't reject, with all their columns, of any name; a null lang becomes the predicted one.

    Null texts and texts without a letter go. An empty table gives an empty
    result.
    """

    def run(batches):
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column("_text")]
            b = pa.RecordBatch.from_arrays([b.column("_row"), pa.array([g[0] for g in got], pa.string())], ["_row", "_lang"])
            yield b.filter(pa.array([not g[2] for g in got], pa.bool_()))

    bounded_batches(docs.sparkSession)
    kind = StructType([StructField("_row", docs.schema), StructField("_lang", StringType())])
    kept = docs.select(row_struct(docs).alias("_row"), F.col("text").alias("_text")).mapInArrow(run, kind)
    row = F.col("_row")
    return kept.select(*[(F.coalesce(row.getField(c), F.col("_lang").cast(docs.schema[c].dataType)) if c == "lang" else row.getField(c)).alias(c) for c in docs.columns])


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: learns from the documents that aren't held out and predicts all."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
