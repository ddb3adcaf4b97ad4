"""Load the parquet test tables by name."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows over as many partitions as ``spark.siftkit.scanPartitions`` says, if it is set.

    For local runs over files of one row group, which are one task else; a cluster leaves it
    unset and takes the scan's own splits.
    """
    n = df.sparkSession.conf.get("spark.siftkit.scanPartitions", None)
    return df.repartition(int(n)) if n else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for much work on rows of few bytes: a scan makes one task of a small file."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
