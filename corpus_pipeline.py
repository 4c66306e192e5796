"""documents -> packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the frame that is written as
Parquet and read again as the next one's docs. All but the last keep the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quoteloom.llm import chunk_dedup, langid, mixing, near_join, packing
from quoteloom.llm.common import documents, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known by the nearest centroid; a missing lang is filled in."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return chunk_dedup.keep_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 of their five-word shingles, the one with the smallest doc_id."""
    return near_join.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.keep_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL for centroids, components, random rounding and a tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None
