"""Small helpers shared by the column builders."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
# Split marks of the article splitter, in the reference's order.
ARTICLE_SPLIT_MARKS = ("。", "，", ",", "？", "！")
# Marks that end the context around a name mention.
SENTENCE_MARKS = ("，", "。", "！", "？", ",", "!", "?")
# Words marking a gendered two-character name.
GENDER_WORDS = ("女", "男")
# Latin marks used with the Latin test tables.
LATIN_MARKS = (".", ",", "!", "?")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_class(chars: Iterable[str], negate: bool = False) -> str:
    """A regex character class valid in both Java and RE2."""
    body = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)
    return f"[{'^' if negate else ''}{body}]"


def last_mark_regex(marks: Iterable[str]) -> str:
    """Prefix up to and including the last mark; its length is the 1-based mark position."""
    return "(?s)^.*" + char_class(marks)


def lead_regex(marks: Iterable[str]) -> str:
    """Run of non-marks at the start; its length is the 0-based first-mark index."""
    return "^" + char_class(marks, negate=True) + "*"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (one-element ``transform``)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def java_quote(text: Column) -> Column:
    """Quote a string column as a literal Java regex."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def sub(text: Column, pos, length) -> Column:
    """1-based ``substring`` with column or int bounds."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return text.substr(as_col(pos), as_col(length))
