"""Exact deduplication with a sharded cuckoo-filter index.

Texts are equal when they are identical after each run of ASCII white space becomes one
space.  Their SHA-256 digests are dealt to shards by their first bytes.  A shard holds a
cuckoo filter (16-bit fingerprints, four to a bucket, two candidate buckets each) and the
live digests themselves, bucketed the same way.  A digest that misses the filter is surely
new; a hit is verified against the bucket's digests; an insertion that overflows doubles
the filter and refills it from the stored digests.  Deletion takes a live digest out of
both.

Scale: only digests move, never texts.  Each scan task first merges its own copies, so a
group that holds a third of all rows sends one row a task.  The number of shards grows with
the rows, so a shard stays at about ``SHARD_ROWS`` digests.

Defined results: null text counts as empty.  A null doc_id comes after every other; a group
of null ids only has keep_id null.  Rows that repeat a doc_id with equal texts are one
document: each of them counts in group_size and carries the same ``kept``; ``keep_first``
returns one of them.  Extra columns pass through ``keep_first`` untouched.  An empty table
gives an empty result.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_names, shuffle_partitions, skew_join, text_of, written

SHARD_ROWS = 250_000
SLOTS, KICKS = 4, 200


class CuckooIndex:
    """Live digests of one shard: a cuckoo filter in front of bucketed full digests.

    ``content`` maps a digest's first bucket to its stored digests with their entries.
    """

    def __init__(self, buckets: int = 64):
        self._clear(buckets)
        self.resizes = 0

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.filter: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[int, dict[bytes, list]] = {}

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and the two candidate buckets."""
        mark = int.from_bytes(digest[-2:], "little") or 1
        first = int.from_bytes(digest[-10:-2], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, digest: bytes) -> list | None:
        """The digest's entry, or None; the stored digest decides, the filter only spares the look."""
        mark, a, b = self._place(digest)
        if mark not in self.filter[a] and mark not in self.filter[b]:
            return None
        return self.content.get(a, {}).get(digest)

    def insert(self, digest: bytes, entry: list) -> None:
        """Add a digest that ``find`` does not know."""
        mark, a, b = self._place(digest)
        self.content.setdefault(a, {})[digest] = entry
        if not self._put(mark, a, b):
            self._resize()

    def _put(self, mark: int, a: int, b: int) -> bool:
        for at in (a, b):
            if len(self.filter[at]) < SLOTS:
                self.filter[at].append(mark)
                return True
        at = a
        for kick in range(KICKS):
            bucket = self.filter[at]
            mark, bucket[kick % SLOTS] = bucket[kick % SLOTS], mark
            at = self._other(at, mark)
            if len(self.filter[at]) < SLOTS:
                self.filter[at].append(mark)
                return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled again from the stored digests."""
        stored = [x for bucket in self.content.values() for x in bucket.items()]
        buckets, full = 2 * (self.mask + 1), True
        while full:
            self._clear(buckets)
            self.resizes += 1
            for digest, entry in stored:
                mark, a, b = self._place(digest)
                self.content.setdefault(a, {})[digest] = entry
                if not self._put(mark, a, b):
                    break
            else:
                full = False
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        if self.find(digest) is None:
            return False
        mark, a, b = self._place(digest)
        self.filter[a if mark in self.filter[a] else b].remove(mark)
        del self.content[a][digest]
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content.values():
            yield from bucket.items()


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the SHA-256 of the normalised text (32 bytes) in column ``name``."""
    plain = F.regexp_replace(text_of(), SPACES, " ")
    return docs.withColumn(name, F.unhex(F.sha2(plain.cast("binary"), 256)))


def _merge_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a digest of this task: smallest doc_id, number of rows."""
    rows = [pa.table({"digest": b.column("digest"), "doc_id": b.column("doc_id")}) for b in batches if b.num_rows]
    if not rows:
        return
    got = pa.concat_tables(rows).group_by("digest").aggregate([("doc_id", "min"), ("doc_id", "count", pc.CountOptions("all"))])
    yield from pa.table({"kind": pa.array([1] * len(got), pa.int8()), "digest": got["digest"], "doc_id": got["doc_id_min"],
                         "n": got["doc_id_count"].cast(pa.int64())}).to_batches(max_chunksize=10_000)


def _run_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply stored entries (kind 0), insertions (1) and deletions (2) to the task's shards, in row order."""
    shards: dict[int, CuckooIndex] = {}
    for batch in batches:
        for shard, kind, digest, doc_id, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "digest", "doc_id", "n"))):
            index = shards.setdefault(shard, CuckooIndex())
            if kind == 2:
                index.delete(digest)
            elif (entry := index.find(digest)) is None:
                index.insert(digest, [doc_id, n])
            else:
                entry[0] = min((x for x in (entry[0], doc_id) if x is not None), default=None)
                entry[1] += n
    for shard, index in shards.items():
        items = list(index.items())
        for i in range(0, len(items), 10_000):
            part = items[i:i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(part), pa.int32()), pa.array([d for d, _ in part], pa.binary()),
                 pa.array([e[0] for _, e in part], pa.int64()), pa.array([e[1] for _, e in part], pa.int64())],
                names=["shard", "digest", "keep_id", "n"])


def update_index(rows: DataFrame, shards: int, index: DataFrame | None = None,
                 deleted: DataFrame | None = None) -> DataFrame:
    """The index ``(shard, digest, keep_id, n)`` after insertions and then deletions.

    ``rows`` has ``digest`` and ``doc_id``, one row a document; ``index`` is an earlier
    result with the same number of shards; ``deleted`` has the digests to take out.
    """
    changes = rows.select("digest", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        _merge_own, "kind byte, digest binary, doc_id long, n long")
    if index is not None:
        changes = changes.unionByName(index.select(F.lit(0).cast("byte").alias("kind"), "digest",
                                                   F.col("keep_id").alias("doc_id"), "n"))
    if deleted is not None:
        changes = changes.unionByName(deleted.select(F.lit(2).cast("byte").alias("kind"), "digest",
                                                     F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n")))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return changes.withColumn("shard", shard).repartitionById(shards, "shard") \
        .sortWithinPartitions("kind", F.col("doc_id").asc_nulls_last()).mapInArrow(
            _run_shards, "shard int, digest binary, keep_id long, n long")


def shards_for(rows: int, at_least: int) -> int:
    return max(at_least, math.ceil(rows / SHARD_ROWS), 1)


def assign(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size)`` for every row of ``docs``."""
    spark = docs.sparkSession
    digests = written(with_digest(docs.select("doc_id", "text"), "digest").select("doc_id", "digest"), "digests")
    rows = digests.count()
    index = written(update_index(digests, shards_for(rows, shuffle_partitions(spark))), "cuckoo-index")
    return skew_join(digests, index.select("digest", "keep_id", F.col("n").alias("group_size")), "digest", "group_size", rows)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns as they were."""
    digest, kept_id = free_names(docs, "digest", "kept_id")
    kept = assign(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))) \
        .select(F.col("digest").alias(digest), F.col("keep_id").alias(kept_id)).distinct()
    rows = with_digest(docs, digest).join(
        kept.withColumnRenamed(digest, f"{digest}_k"),
        (F.col(digest) == F.col(f"{digest}_k")) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return rows.dropDuplicates(["doc_id", digest]).select(*docs.columns)


def digest_of(text: str | None) -> str:
    """The digest of one text, for tests and lookups."""
    import re

    return hashlib.sha256(re.sub(SPACES, " ", text or "").encode()).hexdigest()
