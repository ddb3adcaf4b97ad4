"""Periodic runs of words, by tiles scaled to the period.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``max(min_words, 2 q)`` long, that no neighbouring word extends.  With
``m[i] = (word i equals word i + p)`` a run of period p is a maximal stretch of m of at least
``max(p, min_words - p)`` places.

1. **Tiles.**  For the periods of one octave [P, 2P) such a stretch is at least S long, where
   S is the least ``max(p, min_words - p)`` of the octave.  So it holds a multiple of S: a
   boundary.  Around each boundary b lies a tile, the words from b - S to b + S + 2P;
   neighbouring tiles overlap.  A document of n words has about n / S tiles of 4P words an
   octave, and as many octaves as 2P <= n allows.
2. **Solving a tile**, from its own words only.  Periods whose first word after the boundary
   recurs are probed for ``PROBE`` words to either side, which ends nearly all chance
   matches; if one goes on, two Z-functions give all periods of the tile in time linear in
   it: of the words after the boundary (how far the match goes on), and of the words before
   it, reversed (how far it began before).  The match, cut at S to both sides, is an interval
   fragment; it counts if it is at least S long.
3. **Stitching.**  Fragments of a document and period that touch make one interval.  They
   are joined in the solving task as far as it has them, then shuffled by (document, period)
   and joined again; intervals that are too short go.  Multiples of a period give the same
   first and last word, so of equal stretches the least period is the smallest.

Tiles of one document need not share a task: ``tiles`` deals those of documents with over
``max_words`` words out in pieces of as many words, each its own row.

Texts are moved only for documents with a fragment.  Memory of a task is some
``BATCH_WORDS`` words, or one document.

Defined results: null text has no words; rows that repeat a doc_id are solved one by one;
null doc_ids stay.  Extra columns are ignored.  An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, text_of, written

MIN_WORDS = 12
#: Words a chance match is followed before the Z-functions of its tile are made.
PROBE = 16
#: Words solved at once (or one piece, if it is longer).
BATCH_WORDS = 1 << 18
#: Documents of more words are solved in pieces of about as many words of boundaries.
MAX_WORDS = 1 << 20


def spacing(octave: int, min_words: int = MIN_WORDS) -> int:
    """Least number of matching places of a run whose period is in [octave, 2 octave)."""
    return min(max(p, min_words - p) for p in range(octave, 2 * octave)) if octave < min_words else octave


def z_function(s: list) -> list[int]:
    """For each place the length of the longest stretch from there that begins the sequence."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        step = 8  # compare in growing slices, then place by place
        while i + k < n:
            a, b = s[k:k + step], s[i + k:i + k + step]
            if len(b) == step and a == b:
                k += step
                step *= 2
                continue
            if step > 8:
                step = 8
                if a[:8] == b[:8] and len(b) >= 8:
                    k += 8
                    continue
            while i + k < n and s[k] == s[i + k]:
                k += 1
            break
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_boundary(words: list, b: int, octave: int, s: int) -> list[tuple[int, int, int]]:
    """``(period, back, on)`` of all periods of the octave, by the boundary's two Z-functions.

    ``words`` is the tile, ``b`` the boundary in it.  The match of period p runs from ``back``
    places before the boundary (at most s) to ``on`` places after it (at most s).
    """
    last = min(2 * octave, len(words) - b)
    after = z_function(words[b:])
    before = words[max(0, b - s):b][::-1]
    near = words[max(0, b - s):b + last]
    behind = z_function([*before, None, *near[::-1]])
    out = []
    for p in range(octave, last):
        if on := min(after[p], s):
            back = min(behind[len(before) + 1 + last - p], s) if before else 0
            if back + on >= s:
                out.append((p, back, on))
    return out


def solve(ids: np.ndarray, first: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, octave: np.ndarray | None,
          min_words: int = MIN_WORDS) -> np.ndarray:
    """Fragments ``(piece, period, start, end)`` of matching places, from pieces laid end to end in ``ids``.

    Piece k has the words ``first[k]`` to ``first[k] + n[k]``; its boundaries are the multiples of S
    in [lo, hi), counted from the piece's first word.  Equal words of one document have equal
    ids, words of different documents differ.  ``octave`` limits a piece to one octave.
    """
    found: list[np.ndarray] = []
    period = 1
    while len(n) and 2 * period <= n.max():
        s = spacing(period, min_words)
        use = np.flatnonzero(n >= max(2 * period, min_words) if octave is None else (n >= 2 * period) & (octave == period))
        if len(use):
            at0 = -(-lo[use] // s) * s
            each = np.maximum(0, -(-(np.minimum(hi[use], n[use] - period) - at0) // s))
            piece = np.repeat(use, each)
            rank = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            at = np.repeat(at0, each) + rank * s
            found.append(_solve_octave(ids, first[piece], n[piece], at, piece, period, s))
        period *= 2
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return stitch(out)


def _solve_octave(ids, first, n, at, piece, octave, s) -> np.ndarray:
    here = ids[first + at]
    tiles, periods = [], []
    end = first + n - 1
    for p in range(octave, 2 * octave):  # each step is one vector operation over all tiles
        t = first + at + p
        ok = np.flatnonzero((ids[np.minimum(t, end)] == here) & (t <= end))
        if len(ok):
            tiles.append(ok)
            periods.append(np.full(len(ok), p))
    if not tiles:
        return np.zeros((0, 4), np.int64)
    tile, p = np.concatenate(tiles), np.concatenate(periods)
    f, m, b = first[tile], n[tile], at[tile]
    reach = min(s, PROBE)
    on, back = np.ones(len(tile), np.int64), np.zeros(len(tile), np.int64)
    for length, step in ((on, 1), (back, -1)):
        alive = np.arange(len(tile))
        for k in range(1 if step == 1 else 0, reach):
            x = b[alive] + (k if step == 1 else -k - 1)
            inside = (x >= 0) & (x + p[alive] < m[alive])
            alive = alive[inside]
            x = x[inside] + f[alive]
            alive = alive[ids[x] == ids[x + p[alive]]]
            if not len(alive):
                break
            length[alive] += 1
    if s <= PROBE:
        keep = on + back >= s
        return np.stack([piece[tile], p, b - back, b + on], 1)[keep]
    out = []
    for t in np.unique(tile[(on == reach) | (back == reach) | (on + back >= s)]):
        f, m, b = int(first[t]), int(n[t]), int(at[t])
        low = max(0, b - s)
        words = ids[f + low:f + min(m, b + s + 2 * octave)].tolist()
        out += [(piece[t], p, b - back, b + on) for p, back, on in solve_boundary(words, b - low, octave, s)]
    return np.array(out, np.int64).reshape(-1, 4)


def stitch(rows: np.ndarray) -> np.ndarray:
    """Fragments ``(piece, period, start, end)`` that touch or overlap joined."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
    # the ends so far, within a piece and period: a running maximum over numbers that grow from group to group
    group = np.concatenate([[0], np.cumsum(~same)])
    wide = int(rows[:, 3].max()) + 2
    ends = np.maximum.accumulate(rows[:, 3] + group * wide) - group * wide
    new = np.concatenate([[True], ~(same & (rows[1:, 2] <= ends[:-1]))])
    at = np.flatnonzero(new)
    return np.stack([rows[at, 0], rows[at, 1], rows[at, 2], np.maximum.reduceat(rows[:, 3], at)], 1)


# ---------------------------------------------------------------- documents to tiles
PIECES = "row long, octave int, n int, base long, lo int, hi int, ids binary"
DOCS = "row long, doc_id long, n_words long, plain_sha256 string, text string, fragments array<struct<period:int,start:long,stop:long>>"
FRAGMENTS = pa.list_(pa.struct([("period", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))


def word_ids(words: list[bytes], counter: Iterator[int]) -> np.ndarray:
    """Ids of the words, equal for equal ones, taken from ``counter`` so that no other document has them."""
    names: defaultdict = defaultdict(counter.__next__)
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def _pieces(n: int, max_words: int) -> Iterator[tuple[int, int, int]]:
    """``(octave, first boundary, past the last)`` of the pieces of a long document."""
    octave = 1
    while 2 * octave <= n:
        step = max(max_words, 4 * octave)
        for lo in range(0, n - octave, step):
            yield octave, lo, min(lo + step, n - octave)
        octave *= 2


def _read(max_words: int, min_words: int):
    """Arrow task: documents solved where they lie; of longer ones, only the words (their tiles go out as rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        held: list[tuple[int, int | None, list[bytes], bool]] = []
        ids: list[np.ndarray] = []
        total, counter = 0, count()

        def flush() -> pa.RecordBatch:
            n = np.array([0 if far else len(x) for (*_, far), x in zip(held, ids)], np.int64)
            flat = np.concatenate([x for (*_, far), x in zip(held, ids) if not far] or [np.zeros(0, np.int64)])
            got = solve(flat, np.cumsum(n) - n, n, 0 * n, n, None, min_words)
            cuts = np.searchsorted(got[:, 0], np.arange(len(held) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(got[:, 1], pa.int32()), pa.array(got[:, 2]), pa.array(got[:, 3])], names=["period", "start", "stop"]))
            plain = [b" ".join(words) for *_, words, _ in held]
            text = [t.decode() if h[-1] or cuts[i] < cuts[i + 1] else None for i, (h, t) in enumerate(zip(held, plain))]
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                 pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in plain], pa.string()),
                 pa.array(text, pa.string()), lists], names=["row", "doc_id", "n_words", "plain_sha256", "text", "fragments"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_py().encode().split()  # splits at the bytes 20 and 09 to 0D
                held.append((row, doc_id, words, len(words) > max_words))
                ids.append(word_ids(words, counter))
                row += 1
                total += len(words)
                if total >= BATCH_WORDS or len(held) >= 10_000:
                    yield flush()
                    held.clear()
                    ids.clear()
                    total, counter = 0, count()
        if held:
            yield flush()
    return run


def _cut(max_words: int, min_words: int):
    """Arrow task: the tiles of long documents, as pieces of up to ``max_words`` words of boundaries and what overlaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                ids = word_ids(text.as_py().encode().split(), count())
                for octave, lo, hi in _pieces(len(ids), max_words):
                    s = spacing(octave, min_words)
                    base = max(0, lo - s) // s * s  # boundaries stay multiples of s
                    part = ids[base:hi + s + 2 * octave]
                    yield pa.RecordBatch.from_pydict(
                        {"row": pa.array([row]), "octave": pa.array([octave], pa.int32()), "n": pa.array([len(part)], pa.int32()),
                         "base": pa.array([base]), "lo": pa.array([lo - base], pa.int32()), "hi": pa.array([hi - base], pa.int32()),
                         "ids": pa.array([part.astype("<i4").tobytes()], pa.binary())})
    return run


def _solve_pieces(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                one = [np.array([r[k]], np.int64) for k in ("n", "lo", "hi", "octave")]
                got = solve(np.frombuffer(r["ids"], "<i4"), np.zeros(1, np.int64), *one, min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(got), r["row"]), pa.int64()), pa.array(got[:, 1], pa.int32()),
                     pa.array(got[:, 2] + r["base"]), pa.array(got[:, 3] + r["base"])], names=["row", "period", "start", "stop"])
    return run


# ---------------------------------------------------------------- fragments to runs
def stitched(fragments: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(row, runs)``: the fragments shuffled by document and period, joined, and the runs among them by start, then period."""
    order = Window.partitionBy("row", "period").orderBy("start", "stop")
    past = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.coalesce(F.col("start") > past, F.lit(True)).cast("int"))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = marked.withColumn("island", island).groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    long_enough = F.col("stop") - F.col("start") >= F.greatest(F.col("period"), F.lit(min_words) - F.col("period"))
    spans = whole.where(long_enough).select("row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")
    least = spans.groupBy("row", "start", "length").agg(F.min("period").cast("long").alias("period"))
    return least.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
            words = text.as_py().encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            keep = np.cumsum(edge)[:-1] == 0
            out.append(b" ".join([words[i] for i in np.flatnonzero(keep)]).decode())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_words", "runs")), pa.array(out, pa.string())],
                                         names=["row", "doc_id", "n_words", "runs", "collapsed"])


RUNS_TYPE = "array<struct<start:bigint,period:bigint,length:bigint>>"


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed, plain_sha256)``, one row a document.

    ``runs`` is sorted by start, then period.  ``collapsed`` is the text without the words that a
    run holds after its first period, joined by one space, where there is a run; else null, and
    ``plain_sha256`` is the hash of all words joined by one space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    read = written(rows.mapInArrow(_read(max_words, min_words), DOCS), "period-tiles")
    own = read.select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    far = read.where(F.col("n_words") > max_words).select("row", "text")
    pieces = far.mapInArrow(_cut(max_words, min_words), PIECES).repartition("row", "octave", "lo", "base")
    parts = own.unionByName(pieces.mapInArrow(_solve_pieces(min_words), "row long, period int, start long, stop long"))
    runs = written(stitched(parts, min_words), "runs")
    some = read.where(F.col("text").isNotNull()).select("row", "doc_id", "n_words", "text").join(runs, "row")
    some = some.mapInArrow(_collapse, f"row long, doc_id long, n_words long, runs {RUNS_TYPE}, collapsed string")
    none = read.join(runs, "row", "left_anti").select(
        "doc_id", "n_words", F.array().cast(RUNS_TYPE).alias("runs"), F.lit(None).cast("string").alias("collapsed"), "plain_sha256")
    return none.unionByName(some.select("doc_id", "n_words", "runs", "collapsed", F.lit(None).cast("string").alias("plain_sha256")))


def repeat_tail(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; documents whose ``crc32(doc_id)`` ends in 0 have their tail made periodic, as the query's contract sets it.

    With h = crc32 of the decimal doc_id, g = h // 10 and n words: from word a = g % n on, word i
    becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    t = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    t = t.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    t = t.withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) AS int)"))
    made = F.expr("""array_join(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p AS int))),
                     slice(w, a + 1, (n - a) % p)), ' ')""")
    return t.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each document (ties: least start, then period), and hashes of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), (-F.col("_b.a")).alias("length"),
        F.col("_b.period").alias("period"), F.expr("1000 * -_b.a div _b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.coalesce(F.sha2("collapsed", 256), "plain_sha256").alias("collapsed_sha256"))
