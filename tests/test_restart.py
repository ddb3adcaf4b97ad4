"""Streams that are stopped and started again, and batches that are run again; list files of many rows."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from siftkit.plans.screening import screen_articles
from siftkit.sources import files
from siftkit.streaming import screen

from .conftest import SF_SMALL


def folder(name):
    return tempfile.mkdtemp(prefix=f"siftkit-{name}-")


def finish(query):
    query.processAllAvailable()
    query.stop()


def forget_last_commit(checkpoint):
    """As if the process had ended between the last batch's output and its commit."""
    commits = os.path.join(checkpoint, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    return last


def test_totals_go_on_after_a_stop_and_a_replayed_batch_changes_nothing(spark):
    bodies = [(f'{{"ts": {i}, "id": "a", "news": "n"}}' if i % 3 else "broken",) for i in range(30)]
    src, out, ck = folder("req"), folder("totals"), folder("ck")
    schema = "body string"

    def arrive(k):
        spark.createDataFrame(bodies[10 * k:10 * k + 10], schema).coalesce(1).write.parquet(os.path.join(src, f"part{k}"))

    def start():
        return screen.count_stream(screen.read_document_stream(spark, os.path.join(src, "*"), schema), out, ck)

    def totals():
        return {r.status: r["count"] for r in screen.latest_totals(spark, out).collect()}

    arrive(0)
    finish(start())
    assert totals() == {"error": 4, "ok": 6}
    arrive(1)
    finish(start())
    assert totals() == {"error": 7, "ok": 13}
    last = forget_last_commit(ck)
    finish(start())  # runs the last batch again
    assert totals() == {"error": 7, "ok": 13} and str(last) in os.listdir(os.path.join(ck, "commits"))
    arrive(2)
    finish(start())
    assert totals() == {"error": 10, "ok": 20}


def test_screening_goes_on_after_a_stop_and_a_replay(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    src, out, ck = folder("docs"), folder("answers"), folder("ck")

    def run(k=None):
        if k is not None:
            docs.where(F.col("doc_id") % 2 == k).coalesce(1).write.parquet(os.path.join(src, f"part{k}"))
        finish(screen.screen_stream(screen.read_document_stream(spark, os.path.join(src, "*"), docs.schema), out, ck, max_len=511))
        return spark.read.parquet(out).select("doc_id", "has_aml", "names", "split_cnt")

    assert run(0).count() == docs.where("doc_id % 2 = 0").count()
    both = run(1)
    want = screen_articles(docs, max_len=511).select("doc_id", "has_aml", "names", "split_cnt")
    assert both.count() == want.count() and both.exceptAll(want).count() == 0
    forget_last_commit(ck)
    again = run()
    assert again.count() == want.count() and again.exceptAll(want).count() == 0


def test_kafka_addresses():
    assert screen.kafka_options("kafka://a:9092,b:9092/news?startingOffsets=earliest&maxOffsetsPerTrigger=10") == {
        "kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "news", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "10"}
    for bad in ("kafka://a:9092", "kafka:///news", "/some/folder"):
        with pytest.raises(ValueError):
            screen.kafka_options(bad)


def test_list_files_of_many_rows(spark):
    """One task writes far more rows than a batch holds; empty tasks write empty lists."""
    df = spark.range(60_000).select("id", F.concat(F.lit('中 "x"\n], ['), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 2 == 0, 1).alias("n"))
    path = folder("list")
    files.write_json_list(df.coalesce(1), path)
    assert len([n for n in os.listdir(path) if n.startswith("part-")]) == 1
    back = files.read_json_list(spark, path)
    assert back.select("id", "t", F.col("n").cast("int")).exceptAll(df).count() == 0 and back.count() == 60_000
    files.write_json_list(df.limit(0).repartition(2), path)
    with open(os.path.join(path, next(n for n in os.listdir(path) if n.startswith("part-")))) as fh:
        assert fh.read() in ("", "[]\n")  # Spark may not call a task without rows


def test_vocabulary_of_many_files(spark):
    """Line numbers go on from file to file; a repeated token keeps its last."""
    from siftkit.operators.tokens import read_vocab
    path = folder("vocab")
    for k in range(3):
        with open(os.path.join(path, f"v{k}.txt"), "w") as fh:
            fh.write("".join(f" t{i} \n" for i in range(100 * k, 100 * k + 100)) + "same\n")
    got = {r.token: r.id for r in read_vocab(spark, path).collect()}
    assert got["same"] == 302 and got["t0"] == 0 and got["t100"] == 101 and got["t299"] == 301 and len(got) == 301
