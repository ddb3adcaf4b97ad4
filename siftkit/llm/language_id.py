"""Language identification: word first, then progressively shorter character n-grams.

Training counts words per language in a bounded sample of the labelled rows.  The model keeps
the ``MAX_WORDS`` commonest words and ``MAX_GRAMS`` commonest n-grams with their log
frequency in each language.  A known word of a text adds its log frequencies.  An unseen
word backs off: the mean over its known n-grams of length 5, or of 4 if it has none, and so
on down to 1.  The best sum wins; the score is its softmax share.

Scale: the sample's ids (at most ``SAMPLE_DOCS``) and the model are broadcast, both bounded
by parameters; every text is then scored where it lies, with a bounded cache of word scores.

Defined results: ``und`` with score 0 for null text, text without a letter, and every text
if nothing is labelled.  Equal sums go to the language first in code-point order.  A null
doc_id counts as the empty text in the fold's CRC.  Rows that repeat a doc_id are predicted
alike if their texts are.  Extra columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

SAMPLE_DOCS = 20_000
MAX_WORDS = 100_000
MAX_GRAMS = 100_000
GRAMS = (5, 4, 3, 2, 1)
CACHED_WORDS = 300_000
SMOOTH = 0.1
LETTERS = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text is 0 modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Rows of log frequencies (one column a language) of words and of n-grams by length."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs, self.words, self.grams = langs, words, grams
        self.cache: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for n in GRAMS:
            known = [g for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i:i + n])) is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))

    def row(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None and (got := self.cache.get(word)) is None:
            got = self.backoff(word)
            if len(self.cache) < CACHED_WORDS:
                self.cache[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        found = LETTERS((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        counts: dict[str, int] = {}
        for w in found:
            counts[w] = counts.get(w, 0) + 1
        sums = np.fromiter(counts.values(), float, len(counts)) @ np.array([self.row(w) for w in counts])
        best = int(np.argmax(sums))
        return self.langs[best], float(1 / np.exp(sums - sums[best]).sum())


def _log_rows(rows: pa.Table, langs: list[str], key: str, totals: np.ndarray, kinds: int) -> dict[str, np.ndarray]:
    """key -> log frequency in each language; ``totals`` is the number of occurrences a language.

    ``kinds`` is the smoothing's number of keys, each counted once for every language that has it.
    """
    at = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for lang, k, n in zip(rows["lang"].to_pylist(), rows[key].to_pylist(), rows["n"].to_pylist()):
        counts.setdefault(k, np.zeros(len(langs)))[at[lang]] = n
    return {k: np.log((c + SMOOTH) / (totals + SMOOTH * kinds)) for k, c in counts.items()}


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on at most ``sample_docs`` rows of ``docs`` with text and lang, those with the smallest hash of doc_id."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = labelled.join(F.broadcast(chosen), "doc_id").select(
        F.col("lang").cast("string").alias("lang"),
        F.explode(F.regexp_extract_all(F.lower(text_of()), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    words = written(rows.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    def grams_of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length("marked") - (n - 1)), lambda i: F.substring(F.col("marked"), i, F.lit(n)))
        return F.when(F.length("marked") >= n, cut).otherwise(F.array().cast("array<string>"))

    marked = words.withColumn("marked", F.concat(F.lit("^"), "word", F.lit("$")))
    grams = written(marked.select("lang", "n", F.explode(F.concat(*map(grams_of, GRAMS))).alias("gram"))
                    .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())  # one row a language

    def kept(counts: DataFrame, key: str, most: int) -> pa.Table:
        top = counts.groupBy(key).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), key).limit(most)
        return counts.join(F.broadcast(top.select(key)), key).select("lang", key, "n").toArrow()

    def sums(counts: DataFrame, where: Column | None = None) -> np.ndarray:
        got = {r.lang: r.n for r in (counts if where is None else counts.where(where)).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        return np.array([got.get(x, 0) for x in langs], float)

    if not langs:
        return Model([], {}, {})
    top_words, top_grams = kept(words, "word", max_words), kept(grams, "gram", max_grams)
    gram_rows: dict[str, np.ndarray] = {}
    for n in GRAMS:
        own = top_grams.filter(pc.equal(pc.utf8_length(top_grams["gram"]), n))
        gram_rows |= _log_rows(own, langs, "gram", sums(grams, F.length("gram") == n), len(own) + 1)
    return Model(langs, _log_rows(top_words, langs, "word", sums(words), len(top_words) + 1), gram_rows)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, from the text alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)),
                           "doc_id long, held_out boolean, lang_pred string, score double")
