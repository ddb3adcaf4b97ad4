"""Similarity self-join on word shingles with Bayesian pruning of MinHash comparisons.

A document's set is that of its runs of ``WORDS`` words (all its words, if fewer).  Equal sets
are one node.  Nodes that share a band of MinHash values meet in that band's bucket, where the
values of each pair are compared ``STEP`` at a time; a pair is dropped as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls below
``TOLERANCE``.  Pairs that last are verified on their whole shingle sets.

No pair is ever a row.  A bucket's nodes meet in tasks of at most two blocks of ``BLOCK``, which
return a spanning forest of the pairs that lasted.  Only those edges make components, so a
chain of candidates of a much lower similarity falls apart (a pair of 0.53 lasts once in a
hundred or so).  A component's whole sets meet in
the same block-wise way; each task counts its nodes' links and returns a spanning forest of
them, whose components are the classes.

A pair of similarity 0.8 shares no band with probability under 1e-6 (``BANDS`` bands of
``ROWS``), and is pruned with probability ``TOLERANCE`` or so.  Values are compared by 16 bits
of their hashes, so an unequal one passes for equal once in 65,536 times, which only keeps pairs.

Names: a set and a row (doc_id and text) are named by 128 bits; a node's number is given out
when the table of nodes is written, so no two sets share one.

Scale: texts are shuffled once, to the tasks of their component.  Buckets are found by a count a
band key, merged before its shuffle; buckets of one node go, and of buckets with the same nodes
one stays.  Hot buckets get their members by broadcast of the key.  A node's ``LANES`` values (256
bytes) go to each block pair of its buckets.  Tasks are as many as rows ask for.  Comparing
grows with the square of a bucket and of a component, spread over block pairs.

Defined results: null text counts as empty; documents without words are one class without
links.  ``class_id`` is the smallest doc_id of the class, ``copy_id`` that of the node; null
doc_ids come last and give null where there are no others.  ``links`` is the number of other
nodes similar to the document's.  Rows that repeat are members like any others; ``keep_one``
returns one row of each class, with all its columns.  An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, shuffle_partitions, skew_join, text_of, written
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 46, 6
LANES, STEP, TOLERANCE = 128, 32, 1e-6
BLOCK = 512
#: Rows that a task of block pairs gets or so.
TASK_ROWS = 20_000
U64 = np.uint64
_draw = np.random.default_rng(7)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
OFFSETS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=U64)
PLACES = _draw.integers(0, 1 << 63, max(ROWS, WORDS), dtype=U64) * U64(2) + U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words))
    n = min(WORDS, len(h))
    runs = np.full(len(h) - n + 1, U64(n))
    for k in range(n):
        runs = runs + h[k:len(h) - n + 1 + k] * PLACES[k]
    return np.unique(mixed(runs))


def minhash(hashes: np.ndarray, lanes: int = BANDS * ROWS) -> np.ndarray:
    out = np.full(lanes, U64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 512):
        out = np.minimum(out, (hashes[i:i + 512, None] * FACTORS[:lanes] + OFFSETS[:lanes]).min(0))
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    bands = values.reshape(BANDS, ROWS) * PLACES[:ROWS]
    return mixed(bands.sum(1, dtype=U64) + np.arange(BANDS, dtype=U64))


def name_of(hashes: np.ndarray) -> bytes:
    """The set's 128-bit name, zeros for the empty set."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else bytes(16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, bands, values = [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            names.append(name_of(s))
            least = minhash(s)
            bands.append(band_keys(least).view(np.int64) if len(s) else None)
            values.append((mixed(least[:LANES]) >> U64(48)).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
             pa.array(values, pa.binary())], names=["doc_id", "row_key", "name", "bands", "vals"])


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the least number of equal ones with which a pair is not dropped."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, LANES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(logs - logs.max())
            if p[s >= threshold].sum() >= tolerance * p.sum():
                out[n] = m
                break
    return out


class Block:
    """Nodes of one block: numbers, MinHash values (one row a node) and, to verify, shingle sets."""

    def __init__(self, rows: dict[int, tuple[bytes, bytes | None]]):
        self.names = np.array(sorted(rows), np.int64)
        self.values = np.frombuffer(b"".join(rows[n][0] for n in self.names.tolist()), np.uint16).reshape(-1, LANES)
        self.sets = [np.frombuffer(rows[n][1], U64) for n in self.names.tolist() if rows[n][1] is not None]


def surviving(a: Block, b: Block, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) that are not dropped; within one block each pair once."""
    hits = np.zeros((len(a.names), len(b.names)), np.uint8)
    for k in range(STEP):
        hits += a.values[:, k, None] == b.values[None, :, k]
    keep = hits >= least[STEP]
    if a is b:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    n_hits = hits[i, j].astype(np.int64)
    for n in range(2 * STEP, LANES + 1, STEP):
        for x in range(0, len(i), 50_000):
            part = slice(x, x + 50_000)
            n_hits[part] += (a.values[i[part], n - STEP:n] == b.values[j[part], n - STEP:n]).sum(1)
        keep = n_hits >= least[n]
        i, j, n_hits = i[keep], j[keep], n_hits[keep]
    return i, j


def verified(a: Block, b: Block, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (sorted by i) whose sets reach the threshold."""
    if not len(i):
        return i, j
    every, ids = np.unique(np.concatenate([*a.sets, *b.sets]), return_inverse=True)
    cuts = np.cumsum([len(s) for s in [*a.sets, *b.sets]])
    parts = np.split(ids, cuts[:-1])
    of_a, of_b = parts[:len(a.sets)], parts[len(a.sets):]
    there = np.zeros(len(every), bool)
    good = np.zeros(len(i), bool)
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for x, y in zip(starts, [*starts[1:], len(i)]):
        own = of_a[i[x]]
        there[own] = True
        sizes = np.array([len(of_b[k]) for k in j[x:y]])
        shared = np.add.reduceat(there[np.concatenate([of_b[k] for k in j[x:y]])].astype(np.int64), np.cumsum(sizes) - sizes)
        there[own] = False
        good[x:y] = shared >= threshold * (len(own) + sizes - shared) - 1e-9
    return i[good], j[good]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with edges u - v."""
    names, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ids[:len(u)], ids[len(u):]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(names))
    return names[other], names[label[other]]


def compare(a: Block, b: Block, threshold: float, least: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (node, links, other): links to count, or an edge of the spanning forest."""
    i, j = verified(a, b, *surviving(a, b, least), threshold)
    if not len(i):
        return
    u, v = a.names[i], b.names[j]
    names, links = np.unique(np.concatenate([u, v]), return_counts=True)
    child, root = forest(u, v)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([names, child])), pa.array(np.concatenate([links, 0 * child]).astype(np.int64)),
         pa.array([None] * len(names) + root.tolist(), pa.int64())], names=["node", "links", "other"])


def lasting(a: Block, b: Block, least: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v): a spanning forest of the pairs that are not dropped."""
    i, j = surviving(a, b, least)
    if len(i):
        child, root = forest(a.names[i], b.names[j])
        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], names=["u", "v"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
        names = ["component", "node", "block", "blocks", "vals"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "hashes"])


def _each_group(meet: Callable[[Block, Block], Iterator[pa.RecordBatch]], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``meet`` for the blocks ``first`` and ``second`` of every ``key`` of a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                blocks = [Block(held[k]) for k in sorted(held)]
                if group[1] == group[2]:
                    yield from meet(blocks[0], blocks[0])
                elif len(blocks) == 2:
                    yield from meet(blocks[0], blocks[1])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (key, "first", "second", "block", "node", "vals")]
            sets = batch.column("hashes").to_pylist() if "hashes" in batch.schema.names else [None] * len(batch)
            for k, first, second, block, node, values, hashes in zip(*cols, sets):
                if (k, first, second) != group:
                    yield from finish()
                    group, held = (k, first, second), {}
                held.setdefault(block, {})[node] = (values, hashes)
        yield from finish()
    return run


def _blocked(members: DataFrame, size: str) -> DataFrame:
    """``members`` with the number of blocks of their group and the node's own block."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    return members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _met(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """The rows of every two blocks of a group together in one task, sorted by ``key`` and blocks."""
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        key, F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"),
        "block", "node", *(c for c in ("vals", "hashes") if c in rows.columns))
    group = [key, "first", "second"]
    return met.repartition(tasks, *group).sortWithinPartitions(*group)


def _tasks(spark, groups: DataFrame, size: str) -> int:
    """So many tasks that each gets TASK_ROWS rows or so, no fewer than the session's shuffles have."""
    rows = groups.agg(F.sum(F.col(size) * F.ceil(F.col(size) / BLOCK))).first()[0] or 0
    return max(shuffle_partitions(spark), -(-int(rows) // TASK_ROWS))


def buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, n)`` of the buckets with at least two nodes, one of those with the same nodes, and ``(key, n, node)``."""
    keyed = nodes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("key"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"x{k}") for k in (1, 2)]
    kept = keyed.groupBy("key").agg(F.count("*").alias("n"), *same).where("n > 1") \
        .groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n")
    kept = written(kept, "buckets")
    members = skew_join(keyed, kept, "key", "n", nodes.count() * BANDS).where("n IS NOT NULL")
    return kept, members


def candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """``(node, component)``: components of the pairs that share a band and are not dropped."""
    least = least_matches(threshold)
    kept, members = buckets(nodes)
    rows = _blocked(members, "n").join(nodes.select("node", "vals").hint("merge"), "node")
    pairs = _met(rows, "key", _tasks(nodes.sparkSession, kept, "n")).mapInArrow(
        _each_group(lambda a, b: lasting(a, b, least), "key"), "u long, v long")
    return components(pairs)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with 128 bits of the SHA-256 of doc_id and text."""
    both = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), text_of())
    return docs.withColumn(key, F.substring(F.unhex(F.sha2(both, 256)), 1, 16))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, row_key, class_id, copy_id, links, class_row)`` of every row of ``docs``.

    ``row_key`` is a hash of doc_id and text; ``class_row`` that of the class's first row.
    """
    if not 0.75 <= threshold <= 1:
        raise ValueError("the bands are laid out for thresholds of 0.75 and more")
    spark = docs.sparkSession
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), "row_key")
    sketches = written(rows.mapInArrow(_sketch, "doc_id long, row_key binary, name binary, bands array<long>, vals binary"), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))
    nodes = written(sketches.groupBy("name").agg(
        F.min(first).alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"),
        F.any_value("vals").alias("vals")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = written(candidates(nodes, threshold), "candidates")

    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    sizes = written(sizes, "component-sizes")
    members = _blocked(skew_join(found, sizes, "component", "size", found.count()), "size")
    members = written(members.join(nodes.select("node", "vals", F.col("first.row_key").alias("row_key")), "node"), "members")
    # merged at every size: a broadcast on small inputs alone would hide that the texts move
    sets = rows.select("row_key", "text").join(members.hint("merge"), "row_key").select("component", "node", "block", "blocks", "vals", "text") \
        .mapInArrow(_with_sets, "component long, node long, block int, blocks int, vals binary, hashes binary")
    least = least_matches(threshold)
    links = written(_met(sets, "component", _tasks(spark, sizes, "size")).mapInArrow(
        _each_group(lambda a, b: compare(a, b, threshold, least), "component"), "node long, links long, other long"), "links")

    joined = components(links.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = links.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    table = nodes.select("node", "name", "first", "copies").join(counts, "node", "left").join(joined, "node", "left").select(
        "name", "first", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce("component", "node").alias("class"))
    table = written(table, "node-classes")
    heads = table.groupBy("class").agg(F.min("first").alias("head"), F.count("*").alias("size"))
    table = written(skew_join(table, written(heads, "class-heads"), "class", "size", table.count()).select(
        "name", "copies", "links", F.col("head.doc_id").alias("class_id"), F.col("head.row_key").alias("class_row"),
        F.col("first.doc_id").alias("copy_id")), "node-results")
    return skew_join(sketches.select("doc_id", "row_key", "name"), table, "name", "copies", sketches.count()).select(
        "doc_id", "row_key", "class_id", "copy_id", "links", "class_row")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``docs`` (its first by doc_id), all columns as they were."""
    key, kept = free_names(docs, "row_key", "kept_key")
    heads = classes(docs, threshold).where(F.col("row_key") == F.col("class_row")).select(F.col("row_key").alias(kept)).distinct()
    rows = _keyed(docs, key)
    return rows.join(heads, rows[key] == heads[kept], "left_semi").dropDuplicates([key]).select(*docs.columns)
