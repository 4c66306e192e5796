"""BM25 over an inverted index, exact vector neighbours and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import cut

K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_K, SHORTLIST, PER_QUERY = 60, 50, 30
#: Rows that a query block is compared with at once.
BLOCK = 2_048
#: Queries of a pass of bm25_topk(), and documents whose weights a task holds at once.
QUERIES, DOCS = 2_000, 512


def bm25_index(docs: DataFrame, toks: Column) -> dict[str, DataFrame]:
    """docs (doc) and the tokens of each -> postings (term, doc, tf), lengths (doc, dl), terms (term, idf).

    idf = ln((N - df + .5) / (df + .5)); where that is negative, FLOOR times the
    mean over all terms.
    """
    # dealt by document first: the postings, their sums and the lists of each search then need no shuffle of their own
    t = docs.repartition("doc").select("doc", toks.alias("t"))
    # kept, as the statistics and each search read them; texts are tokenised once
    held = t.select("doc", F.explode_outer("t").alias("term")).groupBy("doc", "term").agg(F.count("term").alias("tf")).persist()
    postings = held.where("term IS NOT NULL").select("term", "doc", "tf")
    lengths = held.groupBy("doc").agg(F.sum("tf").alias("dl"))
    n = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    dfs = postings.groupBy("term").agg(F.count("*").alias("df")).persist()
    raw = dfs.crossJoin(F.broadcast(n)).select("term", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return {"postings": postings, "lengths": lengths, "terms": terms, "totals": n}


def _passes(queries: DataFrame, block: int) -> list[DataFrame]:
    """The queries (q, terms), a stated set, in blocks."""
    queries = cut(queries.select("q", "terms"))
    n = max(1, -(-queries.count() // block))
    return [queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i) if n > 1 else queries for i in range(n)]


def bm25_scores(index: dict[str, DataFrame], queries: DataFrame, digits: int = 6, block: int = QUERIES) -> DataFrame:
    """queries (q, terms array; repeated terms count) -> q, doc, score of the documents that share a term.

    As in bm25_topk() queries and terms' weights meet by document: no pair is a row of a shuffle.
    """
    out = None
    for part in _passes(queries, block):
        found = _of_tasks(index, part, None, digits)
        out = found if out is None else out.unionByName(found)
    return out


def ranked(rows: DataFrame, by: str, *order: Column, name: str = "rank") -> DataFrame:
    """Rows with their 1-based rank within ``by``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def bm25_topk(index: dict[str, DataFrame], queries: DataFrame, k: int = PER_QUERY, block: int = QUERIES) -> DataFrame:
    """The best k documents of each query (q, terms); documents that score 0 fill up in order of doc.

    Queries are a stated set, ``block`` of them in a pass. Only postings of their
    terms are read, and they meet by document, not by query: a task multiplies
    its documents' term weights with the queries' and keeps k rows a query, so
    pairs of a query and a document are never rows of a shuffle.
    """
    parts = _passes(queries, block)
    first = index["lengths"].orderBy("doc").limit(k + 1).select("doc")  # only these can fill up
    every = None
    for part in parts:
        met = index["postings"].join(F.broadcast(first), "doc").join(F.broadcast(part.select("q", F.explode("terms").alias("term"))), "term").select("q", "doc").distinct()
        zeros = part.select("q").join(F.broadcast(first)).join(met, ["q", "doc"], "left_anti").withColumn("score", F.lit(0.0)).select("q", "doc", "score")
        found = zeros.unionByName(_of_tasks(index, part, k))
        every = found if every is None else every.unionByName(found)
    return ranked(every.groupBy("q", "doc").agg(F.max("score").alias("score")), "q", F.desc("score"), F.asc("doc")).where(F.col("rank") <= k)


def _of_tasks(index: dict[str, DataFrame], queries: DataFrame, k: int | None, digits: int = 6) -> DataFrame:
    """q, doc, score of the documents that share a term with a block of queries; with k only what may be among a query's best k."""
    asked = queries.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    got = index["terms"].join(F.broadcast(asked), "term").collect()  # the terms of a block of queries
    ids, names = {t: i for i, t in enumerate(sorted({r["term"] for r in got}))}, sorted({r["q"] for r in got})
    place = {q: i for i, q in enumerate(names)}
    weights = np.zeros((len(ids), len(names)))
    for r in got:
        weights[ids[r["term"]], place[r["q"]]] = r["qtf"] * r["idf"] or 1e-300  # a term of no weight is still a common term
    labels, total = np.array(names), index["totals"].first()
    odd = any(r["idf"] <= 0 for r in got)  # then a document with a term of the query may score 0
    avgdl = float(total["avgdl"] or 1.0) if total else 1.0
    spark = queries.sparkSession
    known = spark.createDataFrame(list(ids.items()), "term string, t int")
    lists = index["postings"].join(F.broadcast(known), "term").groupBy("doc").agg(F.collect_list("t").alias("t"), F.collect_list("tf").alias("tf")).join(index["lengths"], "doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.zeros((len(labels), 0))  # of each query the largest k scores that this task has seen
        for pdf in batches:
            for low in range(0, len(pdf) if len(labels) else 0, DOCS):
                p = pdf.iloc[low : low + DOCS].sort_values("doc")
                size, docs = p["t"].str.len().to_numpy(), p["doc"].to_numpy()
                at = np.repeat(np.arange(len(p)), size)
                tf = np.concatenate(p["tf"].to_numpy()).astype(np.float64)
                x = np.zeros((len(p), len(ids)))
                x[at, np.concatenate(p["t"].to_numpy())] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * p["dl"].to_numpy()[at] / avgdl))
                score = np.round(x @ weights, digits).T
                held = ((x > 0).astype(float) @ (weights != 0)).T > 0 if odd or k is None else score != 0
                if k is not None:
                    best = np.concatenate([best, np.where(held, score, -np.inf)], axis=1)
                    if best.shape[1] > k:
                        best = -np.partition(-best, k - 1, axis=1)[:, :k]
                        held &= score >= best.min(1)[:, None]
                q, d = np.nonzero(held)
                yield pd.DataFrame({"q": labels[q], "doc": docs[d], "score": score[q, d]})

    return lists.mapInPandas(run, f"q {queries.schema['q'].dataType.simpleString()}, doc {index['lengths'].schema['doc'].dataType.simpleString()}, score double")


def merge_max(hits: DataFrame, cap: int = SHORTLIST) -> DataFrame:
    """(line, q, doc, score) -> line, doc, its best score over the line's queries, the best ``cap``."""
    best = hits.groupBy("line", "doc").agg(F.max("score").alias("score"))
    return ranked(best, "line", F.desc("score"), F.asc("doc")).where(F.col("rank") <= cap)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def knn(queries: DataFrame, corpus: DataFrame, k: int = PER_QUERY, digits: int = 6, block: int = 50_000) -> DataFrame:
    """Exact neighbours: queries (q, vec), a stated set, against every row of corpus (doc, vec).

    The queries go to every task as a matrix, ``block`` of them in a pass over
    the corpus, so any number of them has a bounded matrix; each task keeps its
    best k of what it scans, so k rows a query, batch and task are shuffled.
    """
    n = queries.count()
    passes = max(1, -(-n // block))
    if passes > 1:
        part = cut(queries.select("q", "vec", F.pmod(F.xxhash64("q"), F.lit(passes)).alias("_pass")))
        hits = [_nearest(part.where(F.col("_pass") == i), corpus, k, digits) for i in range(passes)]
    else:
        hits = [_nearest(queries, corpus, k, digits)]
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    return ranked(every, "q", F.desc("sim"), F.asc("doc")).where(F.col("rank") <= k)


def _nearest(queries: DataFrame, corpus: DataFrame, k: int, digits: int) -> DataFrame:
    got = queries.select("q", "vec").where("vec IS NOT NULL").collect()
    ids = [r["q"] for r in got]
    names = np.array(ids)
    m = np.array([r["vec"] for r in got], np.float64).reshape(len(got), -1)
    m = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.dropna(subset=["vec"]).sort_values("doc")
            for at in range(0, len(pdf), BLOCK) if ids else ():
                part = pdf.iloc[at : at + BLOCK]
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = (x / np.where(n > 0, n, 1.0)).T
                docs = part["doc"].to_numpy()
                for low in range(0, len(ids), BLOCK):
                    sim = np.round(np.clip(m[low : low + BLOCK] @ x, -1, 1), digits)
                    if sim.shape[1] > k:
                        # all that reach the k-th best value: ties are settled by the ranking
                        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
                        q, d = np.nonzero(sim >= least)
                    else:
                        q, d = (v.ravel() for v in np.indices(sim.shape))
                    yield pd.DataFrame({"q": names[low + q], "doc": docs[d], "sim": sim[q, d]})

    return corpus.select("doc", "vec").mapInPandas(run, f"q {queries.schema['q'].dataType.simpleString()}, doc {corpus.schema['doc'].dataType.simpleString()}, sim double")


def rrf(lexical: DataFrame, vector: DataFrame, cap: int = SHORTLIST, k: int = RRF_K) -> DataFrame:
    """Fuses two rankings (q, doc, rank from 1): the sum of 1 / (k + rank - 1), the best ``cap``; source tells who found it.

    A document twice in a list counts with its best rank.
    """
    both = lexical.select("q", "doc", F.col("rank").alias("b"), F.lit(None).cast("int").alias("e")).unionByName(vector.select("q", "doc", F.lit(None).cast("int").alias("b"), F.col("rank").alias("e")))
    one = both.groupBy("q", "doc").agg(F.min("b").alias("b"), F.min("e").alias("e"))
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c) - 1), F.lit(0.0))
    source = F.when(F.col("b").isNotNull() & F.col("e").isNotNull(), "hybrid").when(F.col("b").isNotNull(), "bm25").otherwise("emb")
    scored = one.select("q", "doc", F.round(part("b") + part("e"), 9).alias("score"), source.alias("source"))
    return ranked(scored, "q", F.desc("score"), F.asc("doc")).where(F.col("rank") <= cap)


def expand(hits: DataFrame, work: DataFrame) -> DataFrame:
    """Hits on canonical descriptions (q, canonical_desc, sim) -> their rows of work (doc, canonical_desc), best sim each."""
    return hits.join(work, "canonical_desc").groupBy("q", "doc").agg(F.max("sim").alias("sim"))


def hash_embed(toks: Column, dims: int = 64) -> Column:
    """A deterministic unit vector of hashed tokens: the stand-in where no model is given. Each token is hashed once, and the length is taken once."""
    slots = F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    counts = T.bound(slots, lambda held: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(held, lambda s: s == i)).cast("double")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = T.bound(counts, lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return T.bound(both, lambda b: F.transform(b.v, lambda x: F.when(b.n > 0, x / b.n).otherwise(0.0)))


def missing_descriptions(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct non-blank (company_tab, canonical_desc) that an index doesn't hold."""
    rows = wanted.where("canonical_desc <> ''").select("company_tab", "canonical_desc").distinct()
    return rows.join(known.select("company_tab", "canonical_desc"), ["company_tab", "canonical_desc"], "left_anti")


def index_status(registry: DataFrame, index: DataFrame) -> DataFrame:
    """Per company the registry's and the index's size, ready from 99 % on."""
    r = registry.groupBy("company_tab").agg(F.count("*").alias("registry_size"))
    i = index.groupBy("company_tab").agg(F.count("*").alias("index_size"))
    out = r.join(i, "company_tab", "left").withColumn("index_size", F.coalesce("index_size", F.lit(0)))
    return out.withColumn("ready", F.col("index_size") >= F.floor(F.col("registry_size") * 0.99))
