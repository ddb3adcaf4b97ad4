"""Pattern packing of documents into sequences by non-negative least squares.

Documents become token ids plus an end id; those longer than a sequence are cut into
sequence-long pieces.  From the histogram of piece lengths (one figure a length, so it is
bounded by the sequence length whatever the corpus):

1. patterns of lengths that fill a sequence (at most ``SLACK`` tokens short) are enumerated:
   lengths are drawn as the histogram has them, the last one or two so that the sum comes
   out.  A seeded generator draws, so the same histogram gives the same plan;
2. their repeat counts are fitted to the histogram by non-negative least squares;
3. the counts are rounded up, largest first, as far as the histogram lasts;
4. what is left is a smaller histogram, which goes through 1 to 3 again until a round places
   little (``LEAST``) of it; that residue is packed best fit, longest first, again on the
   histogram: a group of equal sequences takes equal pieces in one step.

The plan is a list of intervals ``(length, first rank, count, first sequence, offset)``.  A
piece's rank among those of its length (tasks count their own; a prefix sum over tasks adds
the start) finds its interval by binary search, so no text and no token moves.

Defined results: null text is empty and gives one piece that holds the end id only.  Rows that repeat a
doc_id are packed one by one.  Extra columns are ignored.  An empty table gives no rows.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import word_cache

LENGTH = 4096
END_ID = 1
#: Tokens that a pattern may leave free.
SLACK = 4
#: Most pieces of a pattern, and pieces of all patterns of a round (they bound the plan's table).
MOST_PIECES, ROUND_PIECES = 128, 100_000
#: Steps of the fit end when the squared error falls by less than this share, or after FIT_STEPS.
FIT_GAIN, FIT_STEPS = 1e-3, 200
#: Rounds of patterns end when one places less than this share of what is left, or after ROUNDS.
LEAST, ROUNDS = 0.02, 12
SEED = 1
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


def _cut(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seen = word_cache(path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.frombuffer(cache.encode(text.as_py()) + end, "<u2")
                for piece, start in enumerate(range(0, len(ids), length)):
                    own = ids[start:start + length]
                    row = (doc_id, piece, start, len(own), zlib.crc32(own.astype("<u4")), part, seen[len(own)])
                    seen[len(own)] += 1
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])
    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """One row a piece; ``rank`` counts the pieces of equal length within the task ``part``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, length), PIECES)


def patterns(hist: np.ndarray, full: int, rng: np.random.Generator, slack: int = SLACK) -> np.ndarray:
    """Different rows of present lengths, in falling order, that add up to ``full`` less at most ``slack``; 0 fills a row up.

    No row uses a length more often than the histogram has it.
    """
    hist = np.asarray(hist, np.int64)
    lengths = np.flatnonzero(hist[:full + 1])
    lengths = lengths[lengths > 0]
    mean = max(1.0, float((lengths * hist[lengths]).sum() / hist[lengths].sum()))
    n = int(min(max(ROUND_PIECES * mean / full, 500), 15_000))
    upto = np.cumsum(hist)  # pieces of at most each length
    below = np.maximum.accumulate(np.where(hist > 0, np.arange(len(hist)), 0))  # the longest present length up to each
    there = hist > 0

    def draw(limit: np.ndarray) -> np.ndarray:
        """A present length of at most the limit, as often as the histogram has it; 0 where there is none."""
        k = (rng.random(len(limit)) * upto[limit]).astype(np.int64)
        return np.where(upto[limit] > 0, np.searchsorted(upto, k, "right"), 0)

    # half begin with any length, half with those that the histogram has most; long ones have few other places
    first = np.where(rng.random(n) < 0.5, rng.choice(lengths, n), draw(np.full(n, full)))
    rows, rest = [first], full - first
    last = draw(np.full(n, full))  # the pattern is closed when no more than this is left
    for _ in range(MOST_PIECES - 3):
        go = rest > last
        if not go.any():
            break
        rows.append(np.where(go, draw(rest), 0))
        rest = rest - rows[-1]
    one, two = np.where(there[rest], rest, 0), np.zeros(n, np.int64)
    for _ in range(12):  # two lengths that add up to the rest
        open_ = (one == 0) & (rest > 0)
        b = draw(rest)
        ok = open_ & (b > 0) & there[rest - b]
        one, two = np.where(ok, b, one), np.where(ok, rest - b, two)
    one = np.where((one == 0) & (rest > slack), below[rest], one)
    out = np.stack([*rows, one, two], 1)
    out = -np.sort(-out, 1)
    out = np.unique(out[out.sum(1) >= full - slack], axis=0)
    # runs of one length may be longer than the histogram has
    used = np.zeros(len(out), bool)
    for k in range(1, out.shape[1]):
        run = (out[:, k:] == out[:, :-k]) & (out[:, k:] > 0)
        used |= (run & (hist[out[:, k:]] <= k)).any(1)
        if not run.any():
            break
    return out[~used, :max(1, int((out > 0).sum(1).max(initial=1)))]


def fit(pats: np.ndarray, hist: np.ndarray, gain: float = FIT_GAIN, most: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that make the patterns' lengths come near the histogram (least squares).

    Multiplicative updates: x stays non-negative and the squared error never grows.
    """
    def made(x: np.ndarray) -> np.ndarray:
        y = np.bincount(pats.ravel(), np.repeat(x, pats.shape[1]), len(hist))
        y[0] = 0
        return y

    def gathered(y: np.ndarray) -> np.ndarray:
        return y[pats].sum(1)

    want = hist.astype(float)
    want[0] = 0
    x = np.full(len(pats), want.sum() / max(1, (pats > 0).sum()))
    target, error = gathered(want), np.inf
    for step in range(most):
        y = made(x)
        if step % 10 == 0:
            now = float(((want - y) ** 2).sum())
            if now >= error * (1 - gain):
                break
            error = now
        x = x * target / np.maximum(gathered(y), 1e-12)
    return x


class Plan:
    """Intervals of pieces: those of ``length`` with rank from ``rank`` on, ``count`` of them, go to as many sequences."""

    def __init__(self, full: int, hist: np.ndarray):
        self.full, self.left = full, hist.astype(np.int64).copy()
        self.used = np.zeros(full + 1, np.int64)
        self.sequences = self.patterned = 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def repeat(self, pats: np.ndarray, counts: np.ndarray) -> int:
        """Use each pattern as often as its count (rounded up) and the remaining pieces allow; the number of sequences."""
        before = self.sequences
        for i in np.argsort(-counts, kind="stable").tolist():
            lens = Counter(v for v in pats[i].tolist() if v)
            n = min(int(np.ceil(counts[i])), *(int(self.left[v]) // k for v, k in lens.items()))
            if n <= 0:
                continue
            at = 0
            for v, k in lens.items():
                for _ in range(k):
                    self.place(v, n, self.sequences, at)
                    at += v
            self.sequences += n
        return self.sequences - before

    def best_fit(self) -> None:
        """Pack what is left, longest first, each into the fullest sequences that take it."""
        frees: list[int] = []
        spaces: dict[int, list[list[int]]] = {}

        def keep(free: int, sequence: int, count: int) -> None:
            if free > 0 and count > 0:
                if free not in spaces:
                    spaces[free] = []
                    insort(frees, free)
                spaces[free].append([sequence, count])

        for length in range(self.full, 0, -1):
            while n := int(self.left[length]):
                i = bisect_left(frees, length)
                if i < len(frees):
                    free = frees[i]
                    sequence, count = spaces[free].pop()
                    if not spaces[free]:
                        del spaces[free], frees[i]
                    k = min(n, count)
                    self.place(length, k, sequence, self.full - free)
                    keep(free - length, sequence, k)
                    keep(free, sequence + k, count - k)
                else:
                    each = self.full // length
                    whole, rest = divmod(n, each)
                    for count, slots in ((whole, each), (1, rest)):
                        if count and slots:
                            for j in range(slots):
                                self.place(length, count, self.sequences, j * length)
                            keep(self.full - slots * length, self.sequences, count)
                            self.sequences += count

    def table(self) -> np.ndarray:
        rows = np.array(self.rows, np.int64).reshape(-1, 5)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def plan(hist: np.ndarray, full: int = LENGTH, seed: int = SEED) -> Plan:
    """The packing of a histogram (``hist[l]`` pieces of length l); its ``patterned`` sequences come from fitted patterns."""
    out, rng = Plan(full, hist), np.random.default_rng(seed)
    for _ in range(ROUNDS):
        left = int(out.left[1:].sum())
        if not left:
            break
        pats = patterns(out.left, full, rng)
        if len(pats):
            out.patterned += out.repeat(pats, fit(pats, out.left))
        if left - int(out.left[1:].sum()) < LEAST * left:
            break
    out.best_fit()
    return out


def _assign(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start")), pa.array(length), batch.column("ids_crc32"),
                 pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of ``docs``."""
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, end_id, length), "pieces")
    by_task = written(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    hist = np.zeros(length + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        hist[r.length] = r.n
    table = spark.sparkContext.broadcast(plan(hist, length).table())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(starts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _assign(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
