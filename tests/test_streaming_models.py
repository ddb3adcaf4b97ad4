"""Streaming gives the same rows as batch; Viterbi equals brute force; J3 equals the pop loop."""
import itertools
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from siftkit.operators.tokens import truncate_pair
from siftkit.plans.models import normaliser_udf, viterbi_udf
from siftkit.plans.screening import screen_articles
from siftkit.streaming.screen import read_document_stream, screen_stream, stream_confusion_matrix

from .conftest import SF_SMALL


def test_screen_stream_equals_batch(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    src = tempfile.mkdtemp(prefix="siftkit-stream-src-")
    for k in range(3):
        docs.filter(F.col("doc_id") % 3 == k).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{k}"))
    stream = read_document_stream(spark, os.path.join(src, "*"), docs.schema)
    out = tempfile.mkdtemp(prefix="siftkit-stream-out-")
    q = screen_stream(stream, out, tempfile.mkdtemp(prefix="siftkit-stream-ck-"), max_len=511)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out).select("doc_id", "has_aml", "names", "split_cnt")
    want = screen_articles(docs, max_len=511).select("doc_id", "has_aml", "names", "split_cnt")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_stream_confusion_matrix(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    pairs = li.select(F.col("l_linenumber").alias("gold"), (F.col("l_partkey") % 7 + 1).alias("pred"))
    src = tempfile.mkdtemp(prefix="siftkit-cm-src-")
    pairs.repartition(3).write.mode("overwrite").parquet(src)
    s = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_confusion_matrix(s).writeStream.outputMode("complete").format("memory").queryName("cm_stream").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.gold, r.pred): r.n for r in spark.sql("SELECT * FROM cm_stream").collect()}
    want = {(r.gold, r.pred): float(r["count"]) for r in pairs.groupBy("gold", "pred").count().collect()}
    assert got == want


def test_viterbi_brute_force(spark):
    rng = np.random.default_rng(3)
    n_tags = 3
    trans = rng.normal(size=(n_tags, n_tags))
    start = rng.normal(size=n_tags)
    rows = []
    for _ in range(20):
        n = int(rng.integers(1, 6))
        rows.append((rng.normal(size=n * n_tags).tolist(),))
    df = spark.createDataFrame(rows, "flat array<double>")
    got = [r[0] for r in df.select(viterbi_udf(trans, start)(F.col("flat"))).collect()]
    for (flat,), path in zip(rows, got):
        em = np.array(flat).reshape(-1, n_tags)
        best = max(itertools.product(range(n_tags), repeat=len(em)),
                   key=lambda p: start[p[0]] + em[0][p[0]] + sum(trans[p[i - 1]][p[i]] + em[i][p[i]] for i in range(1, len(p))))
        assert list(best) == path


def test_normaliser_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    n_tags = 3
    trans, start = rng.normal(size=(n_tags, n_tags)), rng.normal(size=n_tags)
    rows = [(rng.normal(size=n * n_tags).tolist(),) for n in (1, 2, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "flat array<double>").select(normaliser_udf(trans, start)("flat")).collect()]
    for (flat,), z in zip(rows, got):
        em = np.array(flat).reshape(-1, n_tags)
        scores = [start[p[0]] + em[0][p[0]] + sum(trans[p[i - 1]][p[i]] + em[i][p[i]] for i in range(1, len(p)))
                  for p in itertools.product(range(n_tags), repeat=len(em))]
        assert abs(z - np.log(np.exp(scores).sum())) < 1e-9


def test_truncate_pair_cuts_the_longer_side(spark):
    rows = [(list(range(a)), list(range(b)), m) for a in range(0, 9) for b in range(0, 9) for m in (3, 4, 7)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, m int")
    got = df.select(truncate_pair("a", "b", F.col("m")).alias("t")).collect()
    for (a, b, m), r in zip(rows, got):
        la, lb = len(r.t.a), len(r.t.b)
        assert r.t.a == a[:la] and r.t.b == b[:lb] and la + lb == min(len(a) + len(b), m)
        if la < len(a) and lb < len(b):  # both cut: even, the first side takes the odd one
            assert la - lb == m % 2
        elif la < len(a):
            assert la >= lb
        elif lb < len(b):
            assert lb >= la - 1
