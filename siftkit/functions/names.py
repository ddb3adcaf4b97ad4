"""Name rules (B1, B2, B12, C4, C5, D3) as native expressions."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import GENDER_WORDS, char_class, col, java_quote, let

MENTION_TYPE = "array<struct<start:int,end:int>>"


def name_ok(name) -> Column:
    """B1: at least two characters and no ``[UNK]``."""
    n = col(name)
    return (F.length(n) >= 2) & ~F.contains(n, F.lit("[UNK]"))


def has_unk(names) -> Column:
    """B2: any name contains ``[UNK]``."""
    return F.exists(col(names), lambda x: F.contains(x, F.lit("[UNK]")))


def gendered(name, words: Sequence[str] = GENDER_WORDS) -> Column:
    """A two-character name holding a gender word."""
    n = col(name)
    return (F.length(n) == 2) & n.rlike(char_class(words))


def subsumed(name, names) -> Column:
    """A two-character name contained in a different name of the list."""
    n = col(name)
    return (F.length(n) == 2) & F.exists(col(names), lambda x: (x != n) & F.contains(x, n))


def unique_names(names, words: Sequence[str] = GENDER_WORDS) -> Column:
    """D3: order-preserving distinct, without gendered or subsumed two-character names.

    The subsumption test looks at the whole input list, as the reference does.
    """
    ns = col(names)
    return F.array_distinct(F.filter(ns, lambda x: ~gendered(x, words) & ~subsumed(x, ns)))


def mention_spans(text, name, literal: bool = True) -> Column:
    """C4: non-overlapping occurrences of ``name`` in ``text``, left to right.

    Returns ``array<struct<start, end>>`` with 0-based start and exclusive
    end.  ``literal=False`` reads the name as a (Java) regex, as the
    reference does; only then can matches differ in length, so ends are
    computed from the matched text.
    """
    t = col(text)
    n = col(name)
    pattern = java_quote(n) if literal else n
    if literal:  # bound, else each step cuts the text anew
        return let(F.split(t, pattern, -1), lambda pieces: let(F.length(n), lambda size: _mentions(pieces, lambda k: size)))
    lengths = F.transform(F.regexp_extract_all(t, n, 0), lambda m: F.length(m))
    return let(F.split(t, pattern, -1), lambda pieces: let(lengths, lambda matched: _mentions(pieces, lambda k: F.get(matched, k))))


def _mentions(pieces: Column, length: Callable[[Column], Column]) -> Column:
    """The mentions between ``pieces``, the k-th of them ``length(k)`` characters long."""
    init = F.struct(F.lit(0).alias("off"), F.array().cast(MENTION_TYPE).alias("out"))

    def step(acc, k):
        start = acc["off"] + F.length(F.get(pieces, k))
        stop = start + length(k)
        return F.struct(stop.alias("off"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), stop.alias("end")))).alias("out"))

    ks = F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.size(pieces) - 2)) \
        .otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, init, step, lambda acc: acc["out"])
