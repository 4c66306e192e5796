"""Approximate neighbours: vectors in clustered lists, the nearest lists searched, all hits scored exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .retrieval import PER_QUERY, knn, ranked

#: Rows that the centroids are fitted on, lists, and rounds of the fit, at most.
SAMPLE, LISTS, ROUNDS = 20_000, 2_048, 10
#: Queries that the number of lists to search is measured with, and the recall that it has to give there.
PROBE_SAMPLE, RECALL = 200, 0.95
#: Rows and queries of a list that meet in one task; larger lists and query sets are dealt to more.
CELL, ASKED = 20_000, 5_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def _stack(v: pd.Series) -> np.ndarray:
    return unit(np.stack(v.to_numpy()).astype(np.float64))


def _centroids(x: np.ndarray, lists: int) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.bincount(own, minlength=lists)[:, None] > 0, unit(sums), c)
    return c


@dataclass
class Index:
    """Every row of a corpus (doc, vec) with its list, the lists' centroids, how many of them a search looks through, and the recall measured for that."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int
    recall: float


def build(corpus: DataFrame, lists: int | None = None, k: int = PER_QUERY, recall: float = RECALL, sample: int = SAMPLE) -> Index:
    """An index of corpus (doc, vec); null vectors are left out.

    Centroids are fitted on at most ``sample`` rows, those of the lowest hashes;
    every row is put in the list of its nearest centroid. ``probes`` is the least
    number of lists that holds a share ``recall`` of the true k neighbours of up to
    PROBE_SAMPLE rows, found by brute force over the whole corpus.
    """
    rows = cut(corpus.select("doc", "vec").where("vec IS NOT NULL"))
    n = rows.count()
    hashed = F.xxhash64("doc", F.lit(17))
    fit_on = rows.orderBy(hashed, "doc").limit(sample).collect()
    if not fit_on:
        return Index(rows.withColumn("list", F.lit(0)), np.zeros((0, 0)), 1, 1.0)
    x = unit(np.array([r["vec"] for r in fit_on], np.float64))
    count = min(len(x), lists or max(1, min(LISTS, round(n**0.5))))
    c = _centroids(x, count)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield p.assign(list=(_stack(p["vec"]) @ c.T).argmax(1).astype(np.int32))

    dealt = cut(rows.mapInPandas(deal, f"doc {rows.schema['doc'].dataType.simpleString()}, vec {rows.schema['vec'].dataType.simpleString()}, list int"))
    asked = rows.orderBy(F.xxhash64("doc", F.lit(23)), "doc").limit(PROBE_SAMPLE).withColumnRenamed("doc", "q")
    near = knn(asked, rows, k).join(dealt.select("doc", "list"), "doc").join(asked, "q").select("vec", "list").toPandas()  # PROBE_SAMPLE * k rows
    order = np.argsort(np.argsort(-(_stack(near["vec"]) @ c.T), axis=1, kind="stable"), axis=1)
    place = np.sort(order[np.arange(len(near)), near["list"].to_numpy()])
    probes = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
    return Index(dealt, c, probes, float((place < probes).mean()))


def search(index: Index, queries: DataFrame, k: int = PER_QUERY, probes: int | None = None, digits: int = 6) -> DataFrame:
    """queries (q, vec) -> q, doc, sim, rank: the k nearest rows of the lists nearest to each query.

    With as many probes as lists it is exact. The rows of a list are dealt to
    cells of at most about CELL, its queries to groups of about ASKED; a cell
    meets a group in one task, which keeps k rows a query, so a list that holds a
    third of all rows is no single task's.
    """
    c = index.centroids
    kind, doc_kind = queries.schema["q"].dataType.simpleString(), index.rows.schema["doc"].dataType.simpleString()
    if not len(c):
        return queries.sparkSession.createDataFrame([], f"q {kind}, doc {doc_kind}, sim double, rank int")
    probes = min(len(c), probes or index.probes)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                near = np.argsort(-(_stack(p["vec"]) @ c.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"q": np.repeat(p["q"].to_numpy(), probes), "list": near.ravel().astype(np.int32)})

    queries = cut(queries.select("q", "vec").where("vec IS NOT NULL"))
    visits = queries.mapInPandas(ask, f"q {kind}, list int")
    sizes = index.rows.groupBy("list").agg(F.count("*").alias("n"))
    cells = sizes.join(visits.groupBy("list").agg(F.count("*").alias("m")), "list").select("list", F.ceil(F.col("n") / CELL).cast("int").alias("cells"), F.ceil(F.col("m") / ASKED).cast("int").alias("groups"))
    cells = cut(cells)
    pick = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(cells, "list").withColumn("g", pick("q", "groups")).withColumn("c", every("cells")).join(queries, "q").select("list", "c", "g", "q", "vec")
    right = index.rows.join(cells, "list").withColumn("c", pick("doc", "cells")).withColumn("g", every("groups")).select("list", "c", "g", "doc", "vec")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "doc": [], "sim": []})
        b = b.sort_values("doc")
        x, docs, out = _stack(b["vec"]).T, b["doc"].to_numpy(), []
        for low in range(0, len(a), 256):
            part = a.iloc[low : low + 256]
            sim = np.round(np.clip(_stack(part["vec"]) @ x, -1, 1), digits)
            if sim.shape[1] > k:
                qi, di = np.nonzero(sim >= -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k])
            else:
                qi, di = (v.ravel() for v in np.indices(sim.shape))
            out.append(pd.DataFrame({"q": part["q"].to_numpy()[qi], "doc": docs[di], "sim": sim[qi, di]}))
        return pd.concat(out)

    by = ["list", "c", "g"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, f"q {kind}, doc {doc_kind}, sim double")
    return ranked(hits, "q", F.desc("sim"), F.asc("doc")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (q, doc) that was found."""
    n = exact.count()
    return exact.join(found.select("q", "doc"), ["q", "doc"], "left_semi").count() / n if n else 1.0
