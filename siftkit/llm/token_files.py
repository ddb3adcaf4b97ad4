"""Token files: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank by corpus frequency, so the frequent ones fit in one byte.  A
block holds the documents' ids, lengths and ranks: of every four ranks one control byte has
the byte lengths (two bits each, separate from the data bytes).  Blocks are decoded by numpy
through a table of 256 entries that maps a control byte to its four lengths.

Files hold the documents in ascending doc_id order: range partitions, one file each, named
in order by Spark's text writer, whose line feed ends a block (its length is in its head, so
any byte may occur inside).  ``ranks`` beside them maps ranks to ids.

Scale: the ids are made once and shuffled once as 16-bit numbers; counting sends at most a
vocabulary of rows a task; starts are prefix sums with one figure a file.

Defined results: null text is empty: the end id alone.  Null doc_ids come first.  Rows that
repeat a doc_id are all kept, in the order of their ids' bytes.  Extra columns are ignored.
An empty table gives no rows.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .tokens import word_cache

END_ID = 2
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 16 << 20
#: magic, partition, documents, tokens, control bytes, data bytes
HEAD = struct.Struct("<4sIIQQQ")
MAGIC = b"FVB1"
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    lens = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = lens - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < lens[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lens) - lens
    raw = np.frombuffer(data + bytes(3), np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = lens > k
        if not more.any():
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(part: int, doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    every = np.concatenate(ids)
    control, data = encode_ranks(rank_of[every])
    return b"".join([
        HEAD.pack(MAGIC, part, len(ids), len(every), len(control), len(data)),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(), control, data])


def decode_blocks(content: bytes, id_of: np.ndarray) -> Iterator[tuple[int, list[int | None], list[np.ndarray]]]:
    """``(part, doc_ids, ids)`` of each block of a file."""
    at = 0
    while at < len(content):
        magic, part, docs, tokens, n_control, n_data = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEAD.size
        null = np.frombuffer(content, np.uint8, docs, at)
        doc_ids = np.frombuffer(content, "<i8", docs, at + docs).tolist()
        lens = np.frombuffer(content, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        ids = id_of[decode_ranks(content[at:at + n_control], content[at + n_control:at + n_control + n_data], tokens)]
        at += n_control + n_data + 1
        yield part, [None if z else d for z, d in zip(null, doc_ids)], np.split(ids, np.cumsum(lens)[:-1])


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_cache(path), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids = [cache.encode(t.as_py()) + end for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    return run


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, ids)``: the ids of each document and the end id, as little-endian 16-bit numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, ids binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("ids"):
            counts += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])


def _blocks(rank_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), rank_of.value
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_block(part, doc_ids, ids, ranks)], pa.binary())], names=["block"])

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(x.as_buffer(), "<u2"))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield block()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write ``docs`` as token files under ``path/files``, and the ranks' ids under ``path/ranks``."""
    spark = docs.sparkSession
    rows = written(token_ids(docs, tokenizer, end_id), "token-ids", "zstd")
    counts = rows.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = sorted((-r.n, r.id) for r in counts.collect())  # one row an id of the vocabulary
    id_of = np.array([i for _, i in got], np.int64)
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    ranks = [(rank, int(i)) for rank, i in enumerate(id_of)]
    spark.createDataFrame(ranks, "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    tokens = -sum(n for n, _ in got)
    n = max(shuffle_partitions(spark), -(-tokens // FILE_TOKENS))
    blocks = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(_blocks(spark.sparkContext.broadcast(rank_of)), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.text(f"{path}/files")


def _read(id_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                start = 0
                for part, doc_ids, ids in decode_blocks(content.as_py(), id_of.value):
                    lens = np.array([len(x) for x in ids], np.int64)
                    starts = start + np.cumsum(lens) - lens
                    start += int(lens.sum())
                    crc = [zlib.crc32(x.astype("<u4")) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts),
                         pa.array(lens), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # one row an id of the vocabulary
    id_of = np.zeros(max(len(ranks), 1), np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    files = spark.read.format("binaryFile").load(f"{path}/files").select("content")
    rows = written(files.mapInArrow(_read(spark.sparkContext.broadcast(id_of)),
                                    "part int, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
