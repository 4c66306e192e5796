"""Whitening of embeddings by the leading components of their covariance, found without the matrix itself."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored

#: Components, and the columns of the first block of the iteration.
COMPONENTS, FIRST_BLOCK = 8, 32
#: Widest block: it is widened, twice as wide each time, while more than PATIENCE further passes are foreseen.
WIDEST, PATIENCE = 512, 6
#: A component is certified when the residual of its eigenpair is below this share of the largest eigenvalue.
RESIDUAL = 2e-13
#: Components below this share of the largest eigenvalue are rounding, not data.
RANK = 1e-12
SCALE, SHIFT = 1024, 100_000

_LONG = 1 << 62


@dataclass
class Whitening:
    """n, exact sums S of x, unit components (rows), their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty and has neither null nor non-finite entries."""
    v = F.transform(vector, lambda c: c.cast("double"))
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))


def fixed_point(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry, in doubles, as long."""
    return F.transform(vector, lambda c: (F.floor(F.lit(float(SCALE)) * c.cast("double")) + SHIFT).cast("long"))


def _matrix(b: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(batches):
    """Exact sums of a task's rows by entry, as text."""
    total = None
    for b in batches:
        col = b.column("x")
        if len(col):
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
            fits = int(np.abs(x).max()) * len(x) < _LONG
            part = (x if fits else x.astype(object)).sum(0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": [str(v) for v in total]})


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where these hold it, else Python's integers."""
    s = np.array(sums, object)
    if int(np.abs(x).max(initial=0)) * n + int(np.abs(s).max()) < _LONG:
        return x * np.int64(n) - s.astype(np.int64)
    return x.astype(object) * n - s


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding."""
    return scaled_deviation(x, n, sums).astype(np.float64) / n


def _summed(parts: DataFrame) -> np.ndarray:
    """Rows (i, v array) of the tasks summed by entry, combined before the shuffle, as a matrix: d * block numbers reach the driver."""
    got = parts.select("i", F.posexplode("v")).groupBy("i", "pos").agg(F.sum("col").alias("v")).collect()
    out = np.zeros((1 + max(r["i"] for r in got), 1 + max(r["pos"] for r in got)))
    for r in got:
        out[r["i"], r["pos"]] = r["v"]
    return out


def _times(rows: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V Q, trace of V): one pass over the rows, X^T (X Q) of the centred rows, over n."""
    dims = len(sums)

    def run(batches):
        z = np.zeros((dims + 1, q.shape[1]))
        for b in batches:
            c = centred(_matrix(b, "x", dims), n, sums)
            z[:-1] += c.T @ (c @ q)
            z[-1, 0] += (c * c).sum()
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims + 1), pa.int32()), "v": pa.array(z.tolist(), pa.list_(pa.float64()))})

    z = _summed(rows.mapInArrow(run, "i int, v array<double>")) / n
    return z[:-1], float(z[-1, 0])


def fit(rows: DataFrame, k: int = COMPONENTS, first_block: int = FIRST_BLOCK, widest: int = WIDEST, residual: float = RESIDUAL) -> Whitening | None:
    """The first k components of rows (x array<long>, all of one length); None without rows.

    Block subspace iteration: a pass computes V Q, a Rayleigh-Ritz step on the
    block gives pairs and their residuals, and QR of the product gives the next
    block, until the residuals certify all k pairs. The covariance is never
    formed. Where the spectrum is so flat that more than PATIENCE further passes
    are foreseen, random columns widen the block. If rounding keeps the residuals
    above the bound, the iteration ends when they no longer fall.
    """
    got = rows.select("x").mapInArrow(_totals, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not got:
        return None
    n, sums = rows.count(), [int(r["s"]) for r in got]
    dims, rng = len(sums), np.random.default_rng(0)
    k = min(k, dims)
    q = np.linalg.qr(rng.standard_normal((dims, min(dims, max(first_block, 2 * k)))))[0]
    best, stale, passes = math.inf, 0, 0
    while True:
        z, trace = _times(rows, n, sums, q)
        passes += 1
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, product = q @ turn, z @ turn
        top = max(values[0], 0.0)
        some = values[:k] > RANK * top
        off = np.linalg.norm(product[:, :k] - vectors[:, :k] * values[:k], axis=0)[some]
        worst = float(off.max(initial=0.0)) / (top or 1.0)
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        if not top or worst <= residual or (best < 1e-9 and stale >= 3):
            return Whitening(n, sums, vectors[:, :k].T[some], values[:k][some], trace, passes)
        shrink = math.log(max(values[k - 1], RANK * top) / max(values[-1], RANK * top))
        width = min(dims, widest, 2 * q.shape[1]) if math.log(worst / residual) > PATIENCE * shrink else q.shape[1]
        q = np.linalg.qr(np.hstack([product, rng.standard_normal((dims, width - q.shape[1])) * top]))[0]


def whiten(embeddings: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row a usable row of embeddings (vec_id, vector) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(1024 * c) + 100000; deviation is the sum of (n * x -
    S) ** 2, exact, and null where a long doesn't hold it; whitened is x - S / n
    on the component, over the root of its eigenvalue; explained is the
    eigenvalue's share of the trace; identity_error is the largest entry of the
    whitened rows' covariance less the identity. Null vectors and those with null
    or non-finite entries, and empty ones, go; of several lengths the most
    frequent one counts (of equally frequent ones the longest). Components
    without variance are left out, so vectors that are all equal have no rows, nor has an
    empty table. Repeated rows are rows of their own. A null vec_id is kept.
    Other columns aren't read.
    """
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = stored(embeddings.where(usable(F.col(vector))).select("vec_id", fixed_point(F.col(vector)).alias("x")))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return empty
    dims = length["d"]
    one = rows.where(F.size("x") == dims)
    fitted = fit(one, k)
    n, sums, count = fitted.n, fitted.sums, len(fitted.values)
    if not count:
        return empty
    project = (fitted.components / np.sqrt(fitted.values)[:, None]).T

    def gram(batches):
        total = np.zeros((count + 1, count))
        for b in batches:
            y = centred(_matrix(b, "x", dims), n, sums) @ project
            total[:-1] += y.T @ y
            total[-1] += y.sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(count + 1), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})

    total = _summed(one.mapInArrow(gram, "i int, v array<double>")) / n
    identity = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(count)).max())
    explained, names = (fitted.values / fitted.trace).tolist(), empty.columns

    def run(batches):
        for b in batches:
            ids = b.column("vec_id")
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                d = scaled_deviation(_matrix(part, "x", dims), n, sums)
                y = (d.astype(np.float64) / n) @ project
                wide = d if d.dtype != object and len(d) and dims * int(np.abs(d).max()) ** 2 < _LONG else d.astype(object)
                sums_of = [v if v < 1 << 63 else None for v in (wide * wide).sum(1).tolist()]
                own = ids.slice(at, 4096).take(pa.array(np.repeat(np.arange(part.num_rows), count)))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.tile(np.arange(1, count + 1), part.num_rows), pa.int32()), pa.array(np.full(len(own), n), pa.int64()), pa.array([v for v in sums_of for _ in range(count)], pa.int64()), pa.array(y.ravel()), pa.array(explained * part.num_rows), pa.array(np.full(len(own), identity))],
                    names,
                )

    out = stored(one.mapInArrow(run, empty.schema))
    release(rows)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all embeddings on the first eight components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
