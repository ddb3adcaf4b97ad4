"""Text splitting as native expressions.

The splitters are loops over cut positions; they run as ``aggregate`` over a
bounded ``sequence`` inside the row, so no Python worker and no shuffle is
involved.  The loop bound is derived from the text length.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import (ARTICLE_SPLIT_MARKS, SENTENCE_MARKS, col, last_mark_regex,
                     lead_regex, let)


def _by_blocks(text: Column, size: int, body) -> Column:
    """``body(at)`` with ``at(pos, length)`` = ``substring(text, pos, length)`` in constant time.

    The text is cut once into blocks of ``size`` characters; a part of at most ``size + 1``
    characters lies in two neighbours.  Reading from the start of the text at every step
    would make a long text quadratic.
    """
    def bound(blocks):
        def at(pos, length):
            i = F.floor((pos - 1) / size).cast("int")
            both = F.concat(F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, i + 1), F.lit("")))
            return both.substr((pos - i * size).cast("int"), length)
        return body(at)

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)), bound)


def split_article(text, max_len: int = 488, marks: Sequence[str] = ARTICLE_SPLIT_MARKS,
                  end_mark: str = "。", min_tail: int = 3) -> Column:
    """Pieces of at most ``max_len`` characters, as coded in the reference.

    Each step cuts at the last mark inside the next ``max_len`` characters,
    drops the mark and appends ``end_mark``; with no mark it takes
    ``max_len + 1`` characters and skips one.  When more than ``min_tail``
    characters remain, the last piece is re-read from the article's end,
    starting after the first mark of its last ``max_len`` characters, so it
    overlaps the piece before.  Texts of ``min_tail`` characters or fewer give
    an empty array.
    """
    if max_len < 1:
        raise ValueError("max_len must be positive")
    t = col(text)
    last_re = last_mark_regex(marks)
    first_re = lead_regex(marks)
    m = F.lit(max_len)
    init = F.struct(F.lit(1).alias("pos"), F.array().cast("array<string>").alias("pieces"))

    def pieces(at, n):
        # two consecutive steps consume at least max_len + 1 characters
        steps = F.sequence(F.lit(1), (F.ceil(n / F.lit(max_len)) * 2 + 2).cast("int"))

        def step(acc, _i):
            found = F.length(F.regexp_extract(at(acc["pos"], m), last_re, 0))
            cut = let(found, lambda p: F.when(p > 0, p - 1).otherwise(F.lit(max_len + 1)))
            nxt = let(cut, lambda g: F.struct(
                (acc["pos"] + g + 1).alias("pos"),
                F.concat(acc["pieces"],
                         F.array(F.concat(at(acc["pos"], g), F.lit(end_mark)))).alias("pieces")))
            return F.when(n - acc["pos"] + 1 > m, nxt).otherwise(acc)

        def finish(acc):
            window = at(F.greatest(n - m + 1, F.lit(1)), m)
            k = let(window, lambda w: let(F.length(F.regexp_extract(w, first_re, 0)),
                                          lambda i: F.when(i < F.length(w), m - i - 1).otherwise(m - 1)))
            tail = let(k, lambda kk: F.when(kk == 0, t).otherwise(
                at(F.greatest(n - kk + 1, F.lit(1)), m)))
            return F.when(n - acc["pos"] + 1 > F.lit(min_tail),
                          F.concat(acc["pieces"], F.array(tail))).otherwise(acc["pieces"])

        return F.aggregate(steps, init, step, finish)

    return let(F.length(t), lambda n: _by_blocks(t, max_len, lambda at: pieces(at, n)))  # counted once, not at each step


def split_on_mark(text, max_len: int = 512, mark: str = "。") -> Column:
    """Cut before the last ``mark`` of each scan window, the mark opening the next piece.

    As coded in the reference: a window whose only mark is at its first
    character (or that has none) moves the scan index on by ``max_len``, and
    a later cut takes text from the scan index, so the text skipped over is
    lost; the last piece runs from the last real cut to the end.
    """
    if max_len < 1:
        raise ValueError("max_len must be positive")
    t = col(text)
    n = F.length(t)
    m = F.lit(max_len)
    last_re = last_mark_regex([mark])
    # two consecutive steps advance the scan index by at least max_len
    steps = F.sequence(F.lit(1), (F.ceil(n / F.lit(max_len)) * 2 + 2).cast("int"))
    # state: scan index (0-based), start of the open piece, pieces so far
    init = F.struct(F.lit(0).alias("idx"), F.lit(0).alias("start"),
                    F.array().cast("array<string>").alias("pieces"))

    def pieces(at):
        def step(acc, _i):
            p = F.length(F.regexp_extract(at(acc["idx"] + 1, m), last_re, 0))
            cut = acc["idx"] + p - 1
            found = F.struct(
                cut.alias("idx"), cut.alias("start"),
                F.concat(acc["pieces"],
                         F.array(at(acc["idx"] + 1, p - 1))).alias("pieces"))
            moved = F.struct((acc["idx"] + m).alias("idx"), acc["start"].alias("start"),
                             acc["pieces"].alias("pieces"))
            return F.when(acc["idx"] + m < n, F.when(p > 1, found).otherwise(moved)).otherwise(acc)

        def finish(acc):
            return F.when(acc["start"] < n,
                          F.concat(acc["pieces"], F.array(t.substr(acc["start"] + 1, n))))\
                .otherwise(acc["pieces"])

        return F.aggregate(steps, init, step, finish)

    return _by_blocks(t, max_len, pieces)


def mention_sentence(text, start, end, marks: Sequence[str] = SENTENCE_MARKS,
                     min_window: int = 5, max_window: int = 25) -> Column:
    """Context around a mention ``[start, end)`` (0-based) as coded in the reference.

    Right edge: first mark among characters ``end+min .. min(len, end+max)-1``
    (the mark itself excluded); with no mark the edge is the last of those
    characters (also excluded); with no such characters, the text end.
    Left edge: last mark among characters ``start-min-1`` down to
    ``max(0, start-max)``, the text starting after it; with no mark, one past
    the lowest of those characters; with no such characters, 0.
    """
    t = col(text)
    s = col(start)
    e = col(end)
    n = F.length(t)
    first_re = lead_regex(marks)
    last_re = last_mark_regex(marks)

    lo_r = e + min_window
    hi_r = F.least(n, e + max_window)
    rwin = t.substr(lo_r + 1, hi_r - lo_r)
    right = F.when(lo_r >= hi_r, n).otherwise(let(
        F.length(F.regexp_extract(rwin, first_re, 0)), lambda q: F.when(q < hi_r - lo_r, lo_r + q).otherwise(hi_r - 1)))

    lo_l = F.greatest(F.lit(0), s - max_window)
    hi_l = s - min_window
    lwin = t.substr(lo_l + 1, hi_l - lo_l)
    left = F.when(lo_l >= hi_l, F.lit(0)).otherwise(let(
        F.length(F.regexp_extract(lwin, last_re, 0)), lambda p: F.when(p > 0, lo_l + p).otherwise(lo_l + 1)))
    return let(left, lambda begin: t.substr(begin + 1, F.greatest(right - begin, F.lit(0))))
