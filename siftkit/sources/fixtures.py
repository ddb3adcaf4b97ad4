"""Derived fixtures over the test tables (FIXTURES.md part 2).

Model scores are not in the reference, so deterministic arithmetic stands in
for them; every fixture is a Spark expression over the given tables, so its
work grows with them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import col
from .tables import dealt, spread, table

# Fixed values of the fixtures.
WORD_RE = r"\p{L}+"          # a word: a run of letters
KEYWORD_COUNT = 20           # F11: most frequent words ...
KEYWORD_MIN_LEN = 7          # ... longer than 6 letters


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents(doc_id, text)``, its rows dealt out for the per-row work where the session says so."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _two_class(k: Column, n: int) -> Column:
    """Middle of the k-th of n equal parts of (0, 1), and the rest."""
    return F.struct(((k * 2 + 1) / (2.0 * n)).alias("p_pos"), ((2 * n - 1 - k * 2) / (2.0 * n)).alias("p_neg"))


def chunk_score(doc_id, chunk_idx) -> Column:
    """``k = (doc_id*37 + chunk_idx*11) % 100``; p_pos=(2k+1)/200, p_neg=(199-2k)/200."""
    return _two_class((col(doc_id) * 37 + col(chunk_idx) * 11) % 100, 100)


def mention_score(doc_id, chunk_idx, start) -> Column:
    """``k = (doc_id*13 + chunk_idx*7 + start) % 128``; p_pos=(2k+1)/256, p_neg=(255-2k)/256 (exact sums)."""
    return _two_class((col(doc_id) * 13 + col(chunk_idx) * 7 + col(start)) % 128, 128)


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lower-cased letter runs of every document, one row each."""
    return docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_RE), 0))
                       .alias("word"))


def keywords(spark: SparkSession, sf_dir: str, n: int = KEYWORD_COUNT,
             min_len: int = KEYWORD_MIN_LEN) -> DataFrame:
    """the ``n`` most frequent words of at least ``min_len`` letters (count desc, word asc).

    A top-k report: the word count is partially aggregated before its
    shuffle, and the limit bounds the result to ``n`` rows.
    """
    w = words(articles(spark, sf_dir)).filter(F.length("word") >= min_len)
    return (w.groupBy("word").count()
            .orderBy(F.col("count").desc(), F.col("word").asc())
            .limit(n).select(F.col("word").alias("keyword")))


# Fixed values of the post fixture (F12): field words of the forum-post format.
_WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


# The field words that open a line of a post, and their slot types.
FIELD_TAGS = (("餐廳名稱：", "STORE"), ("地址：", "ADDRESS"), ("電話：", "PHONE"), ("消費時間：", "TIME"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one forum post per customer with labelled fields.

    Every third row misses one field (by ``c_custkey % 3``: name, address,
    phone), a phone-less row carries a bare number instead, every seventh
    phone is ``N/A``, every fifth visit date is missing, and each post ends
    with a URL and an IP line.
    """
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    k = F.col("c_custkey")
    wd = F.element_at(F.array(*[F.lit(x) for x in _WEEKDAYS]), (k % 7 + 1).cast("int"))
    mo = F.element_at(F.array(*[F.lit(x) for x in _MONTHS]), (k % 12 + 1).cast("int"))
    date = F.concat_ws(" ", wd, mo, (k % 28 + 1).cast("string"), F.lit("12:34:56"), F.lit("2019"))
    phone = F.when(k % 7 == 3, F.lit("N/A")).otherwise(F.concat(
        F.lit("02-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-"),
        F.lpad(((F.col("c_nationkey") * 37) % 10000).cast("string"), 4, "0")))
    lines = [
        F.concat(F.lit("作者user"), k.cast("string"), F.lit("看板Food標題[食記] "), F.col("c_name"),
                 F.lit("時間"), date),
        F.when(k % 3 != 0, F.concat(F.lit("餐廳名稱："), F.col("c_name"), F.lit(" 本店"))),
        F.when(k % 3 != 1, F.concat(F.lit("地址：No."), k.cast("string"), F.lit(" "),
                                    F.col("c_mktsegment"), F.lit(" Road"))),
        F.when(k % 3 != 2, F.concat(F.lit("電話："), phone)),
        F.when(k % 3 == 2, F.concat(F.lit("Call 09"), F.lpad((k % 100).cast("string"), 2, "0"),
                                    F.lit(" "), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"),
                                    F.lit(" "), F.lpad((k % 1000).cast("string"), 3, "0"))),
        F.when(k % 5 != 0, F.concat(F.lit("消費時間：2019/"), (k % 12 + 1).cast("string"), F.lit("/"),
                                    (k % 28 + 1).cast("string"))),
        F.lit("推 good"),
        F.concat(F.lit("發信站 ptt.cc 來自: "), (k % 256).cast("string"), F.lit("."),
                 F.col("c_nationkey").cast("string"), F.lit(".1."), (k % 100).cast("string")),
    ]
    return dealt(c.select(k.alias("post_id"), F.concat_ws("\n", *lines).alias("content")))


def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as gold ``l_linenumber``, prediction ``l_partkey % 7 + 1``, weight ``l_suppkey % 5 <> 0``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").alias("gold"),
                     (F.col("l_partkey") % 7 + 1).alias("pred"),
                     (F.col("l_suppkey") % 5 != 0).cast("double").alias("w"))


def multilabel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` x classes 0-3: ``m = (doc_id*(13+7c) + 5c) % 100``, prob m/100, logit (m-50)/10.

    Gold is ``quality`` for even classes and ``toxic`` for odd ones.
    """
    lab = table(spark, sf_dir, "labels")
    x = lab.select("doc_id", "quality", "toxic", F.explode(F.array(*[F.lit(c) for c in range(4)])).alias("cls"))
    m = (F.col("doc_id") * (F.col("cls") * 7 + 13) + F.col("cls") * 5) % 100
    return x.select("doc_id", "cls", (m / 100.0).alias("prob"), ((m - 50) / 10.0).alias("logit"),
                    F.when(F.col("cls") % 2 == 0, F.col("quality")).otherwise(F.col("toxic")).alias("gold"))


def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``"[" + lang + ", " + source + "]"`` per document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("["), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]"))
                    .alias("label_list"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests ``{ts, id, news}`` per document; every 50th is cut in half (broken)."""
    d = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.col("doc_id").alias("ts"), F.col("source").alias("id"), F.col("text").alias("news")))
    broken = F.expr("substring(body, 1, cast(length(body) / 2 as int))")
    return d.select("doc_id", body.alias("body")).select(
        "doc_id", F.when(F.col("doc_id") % 50 == 0, broken).otherwise(F.col("body")).alias("body"))
