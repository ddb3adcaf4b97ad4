"""Global row numbers without a single-task window."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import col
from ..session import shared_table


def row_numbers(df: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """``df`` with its 0-based place in ``order``.

    The rows are range-partitioned and numbered within each partition; a prefix sum over one
    count a partition gives where each starts.  ``order`` must be total for the numbers to be
    the same in every run.
    """
    cols = [col(c) for c in order]
    ranged = shared_table(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ordered")
    own = Window.partitionBy("_part").orderBy(*cols)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.row_number().over(own) - 1 + F.col("_start")) \
        .drop("_part", "_start")


def line_numbers(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """``lines``, straight from a text scan, with the 0-based place of each line, files in the order of their paths.

    A scan may read files in any order and cut them into blocks.  A line's place is the number
    of lines in the blocks before its own (one count a block) plus its place there.
    """
    at = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_id"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return at.join(starts, ["_file", "_block"]).withColumn(name, F.col("_id") - F.col("_first") + F.col("_start")).select(*lines.columns, name)
