"""Chunking operators: one output row per piece."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import ARTICLE_SPLIT_MARKS
from ..functions.splitting import split_article, split_on_mark


def split_chunks(df: DataFrame, text: str = "text", max_len: int = 488,
                 marks: Sequence[str] = ARTICLE_SPLIT_MARKS, end_mark: str = "。",
                 keep: Sequence[str] = ("doc_id",), outer: bool = False) -> DataFrame:
    """H11 as rows ``(*keep, chunk_idx, chunk)``; a narrow (map-only) step.

    ``outer=True`` keeps articles with no piece (chunk_idx and chunk null).
    """
    # always the outer form: from the inner one Spark derives a filter that splits once more
    pieces = df.select(*keep, F.posexplode_outer(split_article(F.col(text), max_len, marks, end_mark))
                       .alias("chunk_idx", "chunk"))
    return pieces if outer else pieces.filter(F.col("chunk_idx").isNotNull())


def split_posts(df: DataFrame, text: str = "content", max_len: int = 512,
                marks: Sequence[str] = ("。", "！", " ")) -> DataFrame:
    """H12 once per mark, in order; every other column is copied to each piece."""
    others = [c for c in df.columns if c != text]
    pieces = F.array(F.col(text))
    def split_by(mark: str):
        return lambda p: split_on_mark(p, max_len, mark)

    for mark in marks:
        pieces = F.flatten(F.transform(pieces, split_by(mark)))
    return df.select(*others, F.posexplode(pieces).alias("piece_idx", text))
