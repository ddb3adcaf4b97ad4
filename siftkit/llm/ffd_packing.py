"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

Documents become token ids plus an end id.  Only those longer than a sequence are cut, into
sequence-long pieces and a shorter rest.  Full pieces are sequences of their own and stay
where they lie.  Short pieces are dealt to groups of about ``GROUP`` by a seeded hash of
their row number, so neither sources, equal ids nor equal texts gather in one group.  Each
group is packed alone: pieces in falling length, each into the first sequence that has
room.  The first is found in a tournament tree over the sequences' free room: every node
holds the larger of its two children, so a walk from the root, to the left wherever the left
child is large enough, ends at it; the nodes above are then played again.  A piece costs the
logarithm of the group's sequences.

Texts and ids do not move; the shuffle carries a few numbers a piece.  A group is some four
thousand rows whatever the corpus, and leaves at most one sequence that is not over half full.

Defined results: null text is empty and gives one piece that holds the end id only.  Rows that
repeat a doc_id are packed one by one; null doc_ids stay.  Extra columns are ignored.  An
empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .tokens import word_cache

LENGTH = 2048
END_ID = 1
#: Short pieces a group, on average.
GROUP = 4096
SEED = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, row = word_cache(path), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u2").tobytes()
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.frombuffer(cache.encode(text.as_py()) + end, "<u2").astype("<u4")
                for start in range(0, len(ids), length):
                    own = ids[start:start + length]
                    rows.append((doc_id, start, len(own), zlib.crc32(own), len(ids), row))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)
    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """One row a piece; ``row`` numbers them (the task, then the place in it)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, length), PIECES)


def first_fit(lengths: Sequence[int], full: int) -> list[tuple[int, int]]:
    """``(sequence, offset)`` of each length, in the order given, each in the first sequence with room for it."""
    most = min(len(lengths), 2 * sum(lengths) // full + 1)  # at most one sequence stays at half or less
    size = 1 << max(0, most - 1).bit_length()
    room = [full] * (2 * size)  # node i has the children 2i and 2i + 1; the sequences are the last ``size`` nodes
    out = []
    for n in lengths:
        i = 1
        while i < size:
            i += i
            if room[i] < n:
                i += 1
        out.append((i - size, full - room[i]))
        room[i] -= n
        while i > 1:
            best = max(room[i], room[i ^ 1])
            i >>= 1
            if room[i] == best:
                break
            room[i] = best
    return out


def _pack_group(full: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        placed = np.array(first_fit(table.column("length").to_pylist(), full), np.int64).reshape(-1, 2)
        kept = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array((key[0].as_py() << 32) + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece of ``docs``.

    Full pieces have negative sequence ids; others the group's number and their sequence's in it.
    """
    rows = written(pieces(docs, tokenizer, end_id, length), "short-pieces")
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = rows.where(F.col("length") == length).select(*kept, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group))
    dealt = short.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)).cast("long"))
    return whole.unionByName(dealt.groupBy("group").applyInArrow(_pack_group(length), PACKED))
