"""Chunk gate rules (B3, B4) and the name-score rules (D5, D6) as expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col


def keyword_hit(text, keywords, mode: str = "equals") -> Column:
    """Does ``text`` hit a keyword of the array column ``keywords``.

    ``equals`` is what the reference does (its text is a one-item list, so
    ``in`` tests equality); ``contains`` is the substring test it evidently
    meant.  Blank keywords never hit.
    """
    t = col(text)
    kws = F.filter(col(keywords), lambda k: k != "")
    if mode == "equals":
        return F.coalesce(F.array_contains(kws, t), F.lit(False))
    if mode == "contains":
        return F.coalesce(F.exists(kws, lambda k: F.contains(t, k)), F.lit(False))
    raise ValueError(f"unknown keyword mode {mode!r}")


def rule_check(p_pos, p_neg, hit: Column | None = None, adjust: float = 0.3) -> Column:
    """1 when ``p_pos + adjust >= p_neg``, else 1 when a keyword hits, else 0."""
    passed = col(p_pos) + F.lit(adjust) >= col(p_neg)
    if hit is not None:
        passed = passed | hit
    return passed.cast("int")


def sum_rule(sum_pos, sum_neg, threshold: float = 0.25) -> Column:
    """``sum_pos / (sum_pos + sum_neg) > threshold``."""
    return col(sum_pos) / (col(sum_pos) + col(sum_neg)) > F.lit(threshold)


def max_rule(max_pos, max_neg) -> Column:
    """``max_pos > 0.95 or max_pos > max_neg``."""
    return (col(max_pos) > F.lit(0.95)) | (col(max_pos) > col(max_neg))
