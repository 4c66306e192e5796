"""Session defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; more settings by name."""
    b = SparkSession.builder.master(master).appName("quoteloom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key to some tasks a core, for costly columns: a small Parquet file, or one of a single row group, is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def base_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names for checkpoints; only where none is set (one machine) one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame computed now and with no lineage, so that plans that read it in many places stay small.

    It is stored as Parquet in the folder that the cluster names (base_folder()):
    compressed, and read by the columns that are needed, where a checkpoint has
    whole rows as they are in memory.
    """
    spark = df.sparkSession
    path = f"{base_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
