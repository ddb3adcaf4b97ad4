"""Centroid clustering of integer vectors with the threshold algorithm.

The nearest centroid of a vector is found without measuring all: every dimension has its
centroids in a sorted list.  From the vector's own value each list is walked outward, the
nearer of the two neighbours first; each centroid that a list shows for the first time is
measured exactly.  What no list has shown yet is at least as far, in each dimension, as the
next value on that list (the frontier).  Once the sum of the squared frontier distances
strictly exceeds the best exact distance, no unseen centroid can win or tie, and the walk
ends.  Tasks walk all vectors of an Arrow batch in step.

Rounds of assignment and update follow.  A task adds up its own vectors by cluster, so a
round shuffles one row a task, cluster and dimension; the k new centroids (sums divided by
counts, as whole numbers) are all that the driver gets.  The whole vectors are written
once, as integers, and read in each round.

Defined results: vectors of another length, null, or with a null or non-finite component are
left out.  Rows that repeat a vec_id are clustered one by one; null vec_ids stay and hash as
an empty text.  Rows of one vec_id start in the order of their components.  Fewer vectors
than centroids give as many centroids.  An empty table gives no rows.  A scaled component
beyond ``MOST`` raises an error that names the vector, as its distances would not fit a
long.  Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: 64 squared differences of such components add up to less than 2^63.
MOST = 1 << 27


class Centroids:
    """k centroids and, for each dimension, their values in order; ties go to the smaller number."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, np.int64)
        k, dims = self.values.shape
        self.order = np.argsort(self.values, axis=0, kind="stable").T  # one row a dimension
        far = np.full((dims, 1), np.iinfo(np.int64).max)
        self.lists = np.concatenate([-far, np.take_along_axis(self.values.T, self.order, 1), far], 1)  # guards at both ends

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``x`` the number of the nearest centroid, the squared distance, and how many were measured."""
        n, dims = x.shape
        k = len(self.values)
        at = np.arange(dims)
        cluster, best, cost = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        right = np.empty((n, dims), np.int64)  # place, guards counted, of the first value not below x
        for d in range(dims):
            right[:, d] = np.searchsorted(self.lists[d, 1:-1], x[:, d]) + 1
        left = right - 1
        seen = np.zeros((n, k), bool)
        alive = np.arange(n)
        far = np.iinfo(np.int64).max

        def gap(v, side, sign):
            value = self.lists[at, side]
            return np.where((side < 1) | (side > k), far, sign * (value - v))

        for _ in range(k):
            v, lo, hi = x[alive], left[alive], right[alive]
            below, above = gap(v, lo, -1), gap(v, hi, 1)
            down = below <= above
            shown = self.order[at, np.where(down, lo, hi) - 1]
            fresh = np.zeros((len(alive), k), bool)
            fresh[np.arange(len(alive))[:, None], shown] = True
            fresh &= ~seen[alive]
            row, c = np.nonzero(fresh)
            exact = ((v[row] - self.values[c]) ** 2).sum(1)
            seen[alive[row], c] = True
            cost[alive] += fresh.sum(1)
            table = np.full((len(alive), k), far)
            table[row, c] = exact
            number, least = table.argmin(1), table.min(1)  # the first of equals is the smaller number
            better = (least < best[alive]) | (least == best[alive]) & (least < far) & (number < cluster[alive])
            who = alive[better]
            best[who], cluster[who] = least[better], number[better]
            left[alive], right[alive] = lo - down, hi + ~down
            lo, hi = left[alive], right[alive]
            frontier = np.minimum(gap(v, lo, -1), gap(v, hi, 1))
            done = (frontier == far).any(1)  # a list is at its end: every centroid was shown
            bound = (np.where(done[:, None], 0, frontier) ** 2).sum(1)
            alive = alive[~(done | (bound > best[alive]))]
            if not len(alive):
                break
        return cluster, best, cost


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for vec_id, v in zip(batch.column("vec_id"), batch.column("embedding")):
            if len(v) != DIMENSIONS or v.values.null_count:
                continue
            x = np.floor(SCALE * v.values.to_numpy().astype(np.float64))
            if not np.isfinite(x).all():
                if np.isfinite(v.values.to_numpy()).all():
                    raise ValueError(f"vector {vec_id} has a component beyond {MOST // SCALE}")
                continue
            if np.abs(x).max() > MOST:
                raise ValueError(f"vector {vec_id} has a component beyond {MOST // SCALE}")
            ids.append(vec_id.as_py())
            rows.append(x.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["vec_id", "v"])


def quantised(table: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the whole vectors; ``v`` holds the components floor(64 x) as little-endian 32-bit integers."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull()).mapInArrow(_quantise, "vec_id long, v binary")


def unpack(column: pa.Array, dims: int = DIMENSIONS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``1:<vec_id>``, in ascending hash order."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def _added_up(values: np.ndarray):
    """Arrow task: one row a cluster with the sums and the number of the task's vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(values)
        sums, counts = np.zeros_like(c.values), np.zeros(len(c.values), np.int64)
        for batch in batches:
            x = unpack(batch.column("v"), values.shape[1])
            for lo in range(0, len(x), 4096):
                part = x[lo:lo + 4096]
                cluster, _, _ = c.nearest(part)
                np.add.at(sums, cluster, part)
                counts += np.bincount(cluster, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])
    return run


def update(vectors: DataFrame, values: np.ndarray) -> np.ndarray:
    """The centroids after one round: whole parts of their vectors' means; those without vectors stay."""
    rows = vectors.mapInArrow(_added_up(values), "cluster long, n long, sums array<long>")
    each = rows.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = values.copy()
    for r in each.collect():  # k x dimensions rows
        out[r.cluster, r.d] = int(r.s) // r.n
    return out


def _assigned(values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(values)
        for batch in batches:
            x = unpack(batch.column("v"), values.shape[1])
            parts = [c.nearest(x[lo:lo + 4096]) for lo in range(0, len(x), 4096)]
            if parts:
                cluster, distance, cost = (np.concatenate(p) for p in zip(*parts))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(cost.astype(np.int32))],
                                                 names=["vec_id", "cluster", "distance", "measured"])
    return run


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, measured)`` of each whole vector, and the final centroids.

    ``measured`` is how many centroids the walk measured exactly.
    """
    vectors = written(quantised(table), "vectors")
    values = first_centroids(vectors, k)
    for _ in range(rounds if len(values) else 0):
        values = update(vectors, values)
    if not len(values):
        return vectors.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("measured", "int")))), values
    rows = vectors.mapInArrow(_assigned(values), "vec_id long, cluster int, distance long, measured int")
    return written(rows, "clusters"), values


def report(rows: DataFrame, values: np.ndarray) -> DataFrame:
    """Each vector with its cluster's inertia, the inertia of all and the hash of its centroid."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in values.tolist()]
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    own = own.withColumn("inertia", rows.agg(F.sum("distance")).scalar()).withColumn(
        "centroid_sha256", F.get(F.array(*map(F.lit, names)).cast("array<string>"), "cluster"))
    return rows.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
