"""L1-L4: screening, counters and confusion matrices over streams.

The screening of one article needs all its chunks, and ``screen_articles``
keeps them inside the article row, so the streaming job is stateless: each
micro-batch goes through the same plan (``foreachBatch``), and the sink is
written per batch id, which makes a replayed batch overwrite its own output.
"""
from __future__ import annotations

from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.requests import parse_request, request_status
from ..plans.screening import screen_articles


def kafka_options(address: str) -> dict[str, str]:
    """Spark's options for ``kafka://host:port[,host:port]/topic[?option=value&...]``."""
    parts = urlsplit(address)
    topic = parts.path.strip("/")
    if parts.scheme != "kafka" or not parts.netloc or not topic:
        raise ValueError(f"not kafka://host:port/topic: {address!r}")
    return {"kafka.bootstrap.servers": parts.netloc, "subscribe": topic} | dict(parse_qsl(parts.query))


def read_document_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Rows arriving as Parquet files in the folder ``path``, or as JSON messages of a ``kafka://`` address."""
    if path.startswith("kafka://"):
        raw = spark.readStream.format("kafka").options(**kafka_options(path)).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def screen_stream(stream: DataFrame, out_path: str, checkpoint: str, **screen_kw):
    """L1: screen every arriving article; one parquet folder per micro-batch id."""
    def run(batch: DataFrame, batch_id: int) -> None:
        res = screen_articles(batch, **screen_kw)
        res.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def stream_counters(requests: DataFrame, body: str = "body") -> DataFrame:
    """Running totals of processed and failed requests (use complete mode)."""
    status = request_status(parse_request(F.col(body)))
    return requests.select(status.alias("status")).groupBy("status").count()


def count_stream(requests: DataFrame, out_path: str, checkpoint: str, body: str = "body"):
    """L2: the running totals after each micro-batch, one folder per batch id.

    Totals are the query's state and go on from ``checkpoint`` after a stop; a batch that is
    run again takes the state before it and overwrites its own folder, so it changes nothing.
    """
    def run(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")
    return stream_counters(requests, body).writeStream.outputMode("complete").foreachBatch(run) \
        .option("checkpointLocation", checkpoint).start()


def latest_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """``(status, count)`` after the last batch that ``count_stream`` wrote."""
    rows = spark.read.option("basePath", out_path).parquet(f"{out_path.rstrip('/')}/batch=*")
    return rows.where(F.col("batch") == rows.select(F.max("batch")).scalar()).select("status", "count")


def stream_confusion_matrix(pairs: DataFrame, gold: str = "gold", pred: str = "pred",
                            weight: str | None = None) -> DataFrame:
    """L4: incremental confusion matrix (update or complete mode)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return pairs.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.sum(w).alias("n"))
