"""Helpers shared by the operators: shared scratch tables, skew-safe joins, global order."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: A group with over 1/HOT_SHARE of all rows counts as hot, so at most HOT_SHARE groups are.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor recomputes from the written table, and rows that are
    read twice agree.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """Left join on ``key`` where a few keys may hold most rows of ``left``.

    ``right`` has one row a key and, in ``weight``, how many rows of ``left`` have that key;
    ``rows`` is the size of ``left``.  Keys with over ``rows / HOT_SHARE`` rows are at most
    HOT_SHARE, since the weights add up to ``rows`` at most; their rows meet them by
    broadcast where they lie.  All others are shuffled by key, none with many rows.  Null
    keys match nothing and stay where they lie.
    """
    limit = rows / HOT_SHARE
    hot, cold = right.where(F.col(weight) > limit), right.where(F.col(weight) <= limit)
    rest = left.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti")
    missing = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c != key]
    parts = [
        left.join(F.broadcast(hot), key),
        rest.join(cold, key, "left"),
        left.where(F.col(key).isNull()).select(*left.columns, *missing),
    ]
    columns = [*left.columns, *(c for c in right.columns if c != key)]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def in_order(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None,
             index: str = "index") -> DataFrame:
    """``df``, written in a global order, with the place of each row (from 0) in ``index``.

    Range partitioning sorts the rows; a row's place is the number of rows in earlier
    partitions (one figure a partition is broadcast) plus its place in its own.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    place = F.monotonically_increasing_id()
    rows = written(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(index, F.col("_start") + F.col("_at")) \
        .drop("_part", "_at", "_start")
