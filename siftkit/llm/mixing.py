"""Mixing sources to target weights.

Sizes (words) are added up per source; each source's target is its share of all words by
weight, at most ``MOST`` times what it has, the excess going to the others by weight.  The
repetition rate of a source is target / size.  Every document is taken floor(rate) times,
plus once more if a number drawn from the SHA-256 of seed and doc_id is below the fraction.
The hash holds ``DRAWS`` such numbers; each source uses the one of them with which its taken
words come nearest its target.

Scale: one scan, a partial sum per source, and a join on the source whose hot keys (at most
``HOT_SHARE``) are broadcast.  The targets are found by a few aggregates over the table of
sources, one row each to the driver.

Defined results: null text has size 0.  A null source is a source of its own, last in
order.  A source without words has target 0, as has every source of a table without words.
Rows that repeat a doc_id draw the same number.  A null doc_id draws by the text's MD5.
Equally near draws: the first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, free_names, in_order, skew_join, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = "mix-1"
DRAWS = 8


def _key(source: str = "source") -> Column:
    """Sources in code-point order with null last: a mark before each."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def _draw_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of().cast("binary")))


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, draw_key, size)`` of every row."""
    return docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"),
        _draw_key().alias("draw_key"),
        F.regexp_count(text_of(), F.lit(WORDS)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(key, source_size, n, target)`` per source; ``key`` is the source marked so that null is a key too."""
    sums = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = in_order(sums, [F.col("key")], "sources", index="rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked.select("key", "source_size", "n", weight.alias("weight"),
                                  (F.col("source_size") * most).alias("top")), "source-sizes")
    level, before = 0.0, None
    while level != before:
        before = level
        capped = F.col("weight") * before > F.col("top")
        total, taken, rest = table.agg(
            F.sum("source_size").cast("double"), F.sum(F.when(capped, F.col("top")).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        level = (total - taken) / rest if rest else before
    return table.withColumn("target", F.least(F.col("weight") * level, F.col("top"))).drop("weight", "top")


def _hash(draw_key: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), draw_key).cast("binary"), 256)


def _times(rate: Column, digest: Column, draw: Column | int) -> Column:
    """floor(rate), plus one if the draw (its number from 0) is below the fraction."""
    part = F.substring(digest, (F.lit(draw) if isinstance(draw, int) else draw) * 8 + 1, F.lit(8))
    number = F.conv(part, 16, 10).cast("long") / float(1 << 32)
    return F.floor(rate) + (number < rate - F.floor(rate)).cast("long")


def _plan(docs: DataFrame, weights: tuple[float, ...], most: float, seed: str) -> tuple[DataFrame, DataFrame, int]:
    """The sized rows; per source its size, rows, target, repetition rate and draw; the number of rows."""
    sizes = written(sized(docs).withColumn("key", _key()).withColumn("digest", _hash(F.col("draw_key"), seed)), "sizes")
    n = sizes.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = source_targets(sizes, weights, most).withColumn("rate", rate)
    taken = [F.sum(F.col("size") * _times(F.col("rate"), F.col("digest"), k)).alias(f"taken{k}") for k in range(DRAWS)]
    tried = skew_join(sizes, rates, "key", "n", n).groupBy("key").agg(F.max("target").alias("aim"), *taken)
    off = F.array(*(F.abs(F.col(f"taken{k}") - F.col("aim")) for k in range(DRAWS)))
    draws = tried.select("key", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("draw"))
    return sizes, written(rates.join(draws, "key"), "source-rates"), n


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``(doc_id, draw_key, size, source_size, target, copies)`` for every row of ``docs``."""
    sizes, rates, n = _plan(docs, weights, most, seed)
    rows = skew_join(sizes, rates, "key", "n", n)
    return rows.select("doc_id", "draw_key", "size", "source_size", "target",
                       _times(F.col("rate"), F.col("digest"), F.col("draw")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with all columns as they were.

    The rate depends on the source alone, so the rates (not the copies) are joined to the
    documents, and only texts of sources with under 1/HOT_SHARE of all rows are shuffled.
    """
    _, rates, rows = _plan(docs, weights, most, seed)
    key, n, rate, draw, copy = free_names(docs, "mix_key", "mix_n", "mix_rate", "mix_draw", "mix_copy")
    joined = skew_join(docs.withColumn(key, _key()), rates.select("key", "n", "rate", "draw").toDF(key, n, rate, draw), key, n, rows)
    times = _times(F.col(rate), _hash(_draw_key(), seed), F.col(draw)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
