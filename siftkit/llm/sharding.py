"""Two-pass external shuffle into shards.

Pass one scatters the rows by a seeded hash of doc_id and text over buckets of about
``BUCKET_BYTES`` each, so each fits in memory even where many rows have one doc_id.  Pass two puts each bucket into a fixed
order, Fisher-Yates shuffles it with a generator seeded by (seed, bucket) and writes it.
The buckets laid end to end are the shuffled table; row i of it goes to shard i mod shards,
slot i div shards, so shard counts differ by one at most (law ``rows``).

Scale: texts are shuffled once.  The number of buckets grows with the bytes; bucket sizes
come from a scan, one figure a bucket.

Defined results: null text has 1 byte (the added one) and CRC 0.  Null doc_ids scatter by
their text.  Rows that repeat doc_id and text are placed in the order of a hash of all their
columns (maps left out); those that agree in all are interchangeable, and share a bucket.  Every column is kept in the written ``record``, so no name can clash.  An
empty table gives no shards.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, text_of

SHARDS = 8
SEED = 20_24
BUCKET_BYTES = 32 << 20
OUT_BYTES = 8 << 20


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A uniform permutation of 0 .. n-1."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).random(max(n, 1))
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _shuffle_buckets(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        del got
        by = rows.select(["_bucket", "_id", "_crc", "_size", "_rest"])
        order = pc.sort_indices(by, [(c, "ascending") for c in by.column_names]).to_numpy()
        buckets = by.column("_bucket").to_numpy()[order]
        sizes = by.column("_size").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
        for a, b in zip(cuts, cuts[1:]):
            bucket = int(buckets[a])
            mixed = order[a:b][fisher_yates(int(b - a), seed, bucket)]
            ends = np.cumsum(sizes[mixed]) // OUT_BYTES  # batches of about OUT_BYTES
            parts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(mixed)]
            for x, y in zip(parts, parts[1:]):
                part = rows.select(["record"]).take(pa.array(mixed[x:y])).combine_chunks()
                part = part.append_column("_bucket", pa.array(np.full(y - x, bucket, np.int64))) \
                    .append_column("_at", pa.array(np.arange(x, y, dtype=np.int64)))
                yield from part.to_batches()
    return run


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED,
                 bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs`` shuffled under ``path``: columns record (a row of docs), slot and shard."""
    spark = docs.sparkSession
    size = F.octet_length(text_of()).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(math.ceil(total / bucket_bytes), shuffle_partitions(spark))
    crc = F.crc32(text_of().cast("binary"))
    by = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), crc)
    bucket = F.pmod(by, F.lit(buckets)).cast("long")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    starts = starts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    scattered = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), bucket.alias("_bucket"),
                            F.col("doc_id").cast("string").alias("_id"), crc.alias("_crc"), size.alias("_size"),
                            F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind)).alias("_rest")).repartitionById(buckets, F.col("_bucket").cast("int"))
    schema = T.StructType([scattered.schema["record"], scattered.schema["_bucket"], T.StructField("_at", T.LongType())])
    mixed = scattered.mapInArrow(_shuffle_buckets(seed), schema)
    index = F.col("_start") + F.col("_at")
    mixed.join(F.broadcast(starts), "_bucket").select(
        "record", F.floor(index / shards).cast("long").alias("slot"),
        F.pmod(index, F.lit(shards)).cast("int").alias("shard")) \
        .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """The written shards: record, slot, shard."""
    schema = T.StructType([T.StructField("record", record), T.StructField("slot", T.LongType()),
                           T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
