"""Homomorphic multiset fingerprints, in DataFrame functions only.

A text's paragraphs are the pieces between line feeds and after each full stop, exclamation
or question mark that a space follows; empty pieces do not count.  Each paragraph is hashed
to a wide vector and the vectors are added lane by lane, modulo powers of two:

* one lane counts paragraphs (mod 2**32);
* ``STRONG`` lanes hold 32-bit parts of the paragraph's SHA-256 (mod 2**32): two texts with
  the same multiset of paragraphs, in any order, and hardly any others, agree in them;
* ``SIGNS`` lanes hold single bits of its MD5 (mod 2**19), three to a 64-bit number.

So ``add`` and ``remove`` of paragraphs (or of whole fingerprints) need no text.  Twice a
sign lane less the count is a sum of random signs; the cosine of two such vectors estimates
that of the paragraph multisets, which is the likeness (cut at 0).

Scale: everything is computed row by row in the JVM.  The next document by doc_id is found
with one shuffle of texts: doc_ids (ties: the text's hash) fall into ``RANGES`` ranges a
shuffle partition, with about as many rows each, however the ids lie.  The first document of
each range is also sent to the range before it, and ``lead`` runs within the ranges.  What
every task knows are the ranges' first keys, a few a partition.

Defined results: null text is empty; an empty text has a fingerprint of zeros, likeness 1 to
another empty one and 0 to any other.  Null doc_ids come first.  Rows that repeat a doc_id
follow each other in the order of their texts' hashes.  Extra columns are ignored.  An empty
table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_of

STRONG, SIGNS = 8, 120
SHIFTS, FIELD = 20, 20
MASK32 = (1 << 32) - 1
LOW_BITS = sum(1 << FIELD * k for k in range(3))
FIELD_MASK = (1 << FIELD - 1) - 1
FIELDS_MASK = sum(FIELD_MASK << FIELD * k for k in range(3))
#: Ranges a shuffle partition.
RANGES = 4


def paragraphs(text: Column) -> Column:
    for mark in ".!?":
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    return F.filter(F.split(text, "\n", -1), lambda p: p != "")


def _number(digits: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digits, start, length), 16, 10).cast("long")


def fingerprint(text: Column) -> Column:
    """Lanes as an array of longs: the count, the strong lanes, the packed sign lanes."""
    zero = F.lit(0).cast("long")

    def total(marks: Column, part, mask: int) -> Column:
        return F.aggregate(marks, zero, lambda a, p: (a + part(p)).bitwiseAND(F.lit(mask)))

    def strong(i: int):
        return lambda p: _number(p["strong"], 8 * i + 1, 8)

    def bits(half: str, shift: int):
        return lambda p: F.shiftright(p[half], shift).bitwiseAND(F.lit(LOW_BITS))

    def lanes(marks: Column) -> Column:
        return F.array(F.size(marks).cast("long"), *(total(marks, strong(i), MASK32) for i in range(STRONG)),
                       *(total(marks, bits(half, j), FIELDS_MASK) for half in ("low", "high") for j in range(SHIFTS)))

    hashed = F.transform(paragraphs(text), lambda p: F.struct(
        F.sha2(p.cast("binary"), 256).alias("strong"), F.md5(p.cast("binary")).alias("signs")))
    marks = F.transform(hashed, lambda h: F.struct(
        h["strong"].alias("strong"), _number(h["signs"], 1, 15).alias("low"), _number(h["signs"], 16, 15).alias("high")))
    # the one-element transform names the hashed paragraphs, so that they are made once
    return F.element_at(F.transform(F.array(marks), lanes), 1)


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: (F.element_at(a, i) + F.element_at(b, i)).bitwiseAND(
        F.when(i <= STRONG + 1, F.lit(MASK32)).otherwise(F.lit(FIELDS_MASK))))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of ``a``'s paragraphs without those of ``b``."""
    # the mask plus one in each field is the power itself, so no field borrows from the next
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.when(
        i <= STRONG + 1, (F.element_at(a, i) + F.lit(1 << 32) - F.element_at(b, i)).bitwiseAND(F.lit(MASK32))).otherwise(
        (F.element_at(a, i) + F.lit(FIELDS_MASK) - F.element_at(b, i) + F.lit(LOW_BITS)).bitwiseAND(F.lit(FIELDS_MASK))))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def signed(fp: Column) -> Column:
    """The sign sums, one a lane."""
    packed = F.slice(fp, STRONG + 2, SIGNS // 3)
    counts = F.flatten(F.transform(packed, lambda v: F.array(*(
        F.shiftright(v, FIELD * k).bitwiseAND(F.lit(FIELD_MASK)) for k in range(3)))))
    return F.transform(counts, lambda c: c * 2 - F.element_at(fp, 1))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two arrays of sign sums, between 0 and 1; equal ones give 1."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)

    norms = dot(a, a).cast("double") * dot(b, b).cast("double")
    return F.when(a == b, 1.0).when(norms == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b).cast("double") / F.sqrt(norms))))


def range_of(bounds: Column, key: Column, most: int) -> Column:
    """Place (from 0) of the last of the sorted ``bounds`` (at most ``most``) that is not above ``key``, by halving."""
    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
        up = F.get(bounds, middle) <= key
        return F.when(s["low"] >= s["high"], s).when(up, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

    whole = F.struct(F.lit(0).alias("low"), (F.size(bounds) - 1).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), whole, halve)["low"]


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, fp, next_text, next_fp)``: each row with the next by doc_id, the last with the first."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    partitions = shuffle_partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    key = F.struct("doc_id", "hash")
    ranged = rows.select("doc_id", "hash").repartitionByRange(RANGES * partitions, *order)
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("first"))
    bounds = firsts.agg(F.sort_array(F.collect_list("first"))).scalar()  # a row a range
    placed = rows.withColumn("bounds", bounds).withColumn("block", range_of(F.col("bounds"), key, RANGES * partitions))
    own = F.struct(F.col("block"), F.lit(0).alias("extra"))
    before = F.struct(F.pmod(F.col("block") - 1, F.size("bounds")).alias("block"), F.lit(1).alias("extra"))
    places = F.when(F.get("bounds", F.col("block")) == key, F.array(own, before)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", "hash", F.explode(places).alias("at")).select(
        "doc_id", "text", "hash", "at.block", "at.extra").repartition(partitions, "block")
    dealt = dealt.withColumn("fp", fingerprint(F.col("text")))
    following = Window.partitionBy("block").orderBy("extra", *order)
    return dealt.select("doc_id", "text", "fp", "extra", F.lead("text").over(following).alias("next_text"),
                        F.lead("fp").over(following).alias("next_fp")).where("extra = 0").drop("extra")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compare_edits(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    rows = rows.select("*", signed(F.col("fp")).alias("s"), signed(F.col("edited_fp")).alias("s_edited"),
                       signed(F.col("next_fp")).alias("s_next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                       as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("s"), F.col("s_edited")).alias("near_edited"),
                       likeness(F.col("s"), F.col("s_next")).alias("near_next"))
