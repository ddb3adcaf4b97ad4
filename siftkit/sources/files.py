"""File readers and writers.

Readers return DataFrames with explicit schemas; writers are Spark writes
into folders (one file per task), so they scale with the data.  Paths on a
cluster must be on shared storage.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.order import line_numbers

# Column layouts of the labelled TSV files (label columns, text column).
LAYOUTS = {"binary": (1, 1), "perf": (1, 1), "comp": (4, 4), "senti": (9, 9)}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of the text files under ``path``."""
    return line_numbers(spark.read.text(path)).select("line_no", "value")


def parse_tsv(lines: DataFrame) -> DataFrame:
    """A1: ``(line_no, value)`` -> ``(line_no, cols array<string>)``; no quoting, ragged rows allowed."""
    return lines.select("line_no", F.split("value", "\t").alias("cols"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A1 over files."""
    return parse_tsv(read_lines(spark, path))


def parse_examples(lines: DataFrame, layout: str, split: str) -> DataFrame:
    """A2 + E1: labelled lines -> ``(guid, text, labels)``; ``guid = split-line_no``.

    Test split: column 0 is the text and labels are dummies.
    """
    t = parse_tsv(lines)
    guid = F.concat(F.lit(f"{split}-"), F.col("line_no").cast("string"))
    if layout == "sequence":
        return t.select(guid.alias("guid"), F.get("cols", 1).alias("text"),
                        F.split(F.expr("trim(BOTH '[]' FROM cols[0])"), ", ").alias("labels"),
                        F.split(F.trim(F.get("cols", 2)), " ").alias("tags"))
    n_labels, text_col = LAYOUTS[layout]
    if split == "test":
        dummy = F.array(F.lit("1")) if n_labels == 1 else F.array_repeat(F.lit("0"), n_labels)
        return t.select(guid.alias("guid"), F.get("cols", 0).alias("text"), dummy.alias("labels"))
    return t.select(guid.alias("guid"), F.get("cols", text_col).alias("text"),
                    F.slice("cols", 1, n_labels).alias("labels"))


def read_examples(spark: SparkSession, path: str, layout: str, split: str) -> DataFrame:
    return parse_examples(read_lines(spark, path), layout, split)


def parse_gold_names(lines: DataFrame) -> DataFrame:
    """A3: col 1 text, col 3 comma-joined names; blank lines skipped."""
    t = parse_tsv(lines.filter(F.trim("value") != ""))
    return t.select("line_no", F.get("cols", 1).alias("text"), F.split(F.get("cols", 3), ",").alias("names"))


def read_gold_names(spark: SparkSession, path: str) -> DataFrame:
    return parse_gold_names(read_lines(spark, path))


def parse_gold_slots(lines: DataFrame) -> DataFrame:
    """A4: col 1 text, cols 3-6 store/phone/address/time; rows with fewer than 7 columns skipped."""
    t = parse_tsv(lines).filter(F.size("cols") >= 7)
    return t.select("line_no", F.get("cols", 1).alias("text"), F.get("cols", 3).alias("store"),
                    F.get("cols", 4).alias("phone"), F.get("cols", 5).alias("address"), F.get("cols", 6).alias("time"))


def read_gold_slots(spark: SparkSession, path: str) -> DataFrame:
    return parse_gold_slots(read_lines(spark, path))


def parse_bio(sentences: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A5: ``value`` holds one sentence's ``word ... label`` lines -> ``(*keep, labels, words)`` space-joined.

    ``-DOCSTART-`` lines and empty words or labels are left out, and sentences without words.
    """
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("-DOCSTART-"))
    words = F.filter(F.transform(lines, lambda x: F.get(F.split(F.trim(x), " "), 0)), lambda w: w != "")
    labels = F.filter(F.transform(lines, lambda x: F.element_at(F.split(F.trim(x), " "), -1)), lambda w: w != "")
    out = sentences.select(*keep, F.array_join(labels, " ").alias("labels"), F.array_join(words, " ").alias("words"))
    return out.filter(F.col("words") != "")


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """A5 over files, read one sentence a row (blank lines end them).

    The last piece of a file without a blank line after it is dropped: it is the one that the
    scan delivers without its separator, told by the file's length.
    """
    sep = "\n\n"
    t = spark.read.option("lineSep", sep).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_id"))
    ends = t.groupBy("_file", "_size").agg(F.max("_id").alias("_last"),
                                           F.sum(F.octet_length("value") + len(sep)).alias("_full"))
    cut = ends.filter(F.col("_full") > F.col("_size")).select(F.col("_last").alias("_id"))
    return parse_bio(t.join(F.broadcast(cut), "_id", "left_anti"))


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """Files each holding a JSON list of objects; extra keys pass through."""
    return spark.read.option("multiLine", True).json(path)


def json_list_lines(df: DataFrame) -> DataFrame:
    """The rows of each task as the lines ``value`` of one JSON list, an object a line, non-ASCII kept.

    The brackets and commas are put around the rows as they pass; a task holds one batch at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = []
            for value in batch.column("value").to_pylist():
                lines.append(lead + value)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    return df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string")


def parse_json_list_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """The objects of lines as ``json_list_lines`` makes them; a broken line gives nulls."""
    inner = lines.where(~F.col("value").isin("]", "[]")).select(F.from_json(F.regexp_replace("value", r"^[\[,]", ""), schema).alias("o"))
    return inner.select("o.*")


def write_json_list(df: DataFrame, path: str) -> None:
    """A JSON list a file."""
    json_list_lines(df).write.mode("overwrite").text(path)


def write_label_map(labels: DataFrame, path: str, id_col: str = "id", label_col: str = "label") -> None:
    """``id:label`` lines."""
    labels.select(F.concat_ws(":", F.col(id_col).cast("string"), F.col(label_col)).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)


def parse_label_map(lines: DataFrame, strip_quotes: bool = True) -> DataFrame:
    """``(id, label)`` of ``id:label`` lines; bad lines skipped; surrounding ``'`` stripped from labels (not from tags)."""
    t = lines.select(F.split("value", ":", 2).alias("p"))
    ok = t.filter(F.size("p") == 2).select(F.expr("try_cast(p[0] AS INT)").alias("id"), F.get("p", 1).alias("label"))
    ok = ok.filter(F.col("id").isNotNull())
    if strip_quotes:
        ok = ok.withColumn("label", F.regexp_replace("label", "^'|'$", ""))
    return ok


def read_label_map(spark: SparkSession, path: str, strip_quotes: bool = True) -> DataFrame:
    return parse_label_map(spark.read.text(path), strip_quotes)


def write_thresholds(metrics: DataFrame, path: str) -> None:
    """Only metric keys that end in ``threshold`` are written, one value per line, in key order."""
    metrics.filter(F.col("key").endswith("threshold")).orderBy("key") \
        .select(F.col("value").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def parse_thresholds(lines: DataFrame | None, classes: DataFrame) -> DataFrame:
    """``(class_id, threshold)`` for the ``class_id`` of ``classes``: the parsable lines in order.

    0.5 where there is no line, and for every class when there is no file.  The lines are as
    many as the classes, so they are numbered in one window.
    """
    if lines is None:
        return classes.select("class_id", F.lit(0.5).alias("threshold"))
    t = lines.select("line_no", F.expr("try_cast(value AS DOUBLE)").alias("threshold")).filter(F.col("threshold").isNotNull())
    t = t.select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("int").alias("class_id"), "threshold")
    return classes.join(t, "class_id", "left").select("class_id", F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def read_thresholds(spark: SparkSession, path: str | None, n_classes: int) -> DataFrame:
    classes = spark.range(n_classes).select(F.col("id").cast("int").alias("class_id"))
    return parse_thresholds(None if path is None else read_lines(spark, path), classes)


def parse_keywords(lines: DataFrame) -> DataFrame:
    """A10: one keyword per line; blank lines dropped (they would match everything in contains mode)."""
    return lines.select(F.col("value").alias("keyword")).filter(F.col("keyword") != "")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    return parse_keywords(spark.read.text(path))


def result_log_lines(results: DataFrame, ts: str = "ts", as_json: bool = False) -> DataFrame:
    """``(day, value)`` with ``time, len(article), article, has_aml 1/0, names`` or ``time, json``, tab-joined."""
    time = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    if as_json:
        parts = [time, F.to_json(F.struct(*(F.col(c) for c in sorted(results.columns) if c != ts)))]
    else:
        parts = [time, F.length("article").cast("string"), F.col("article"),
                 F.col("has_aml").cast("int").cast("string"), F.to_json("names")]
    return results.select(F.date_format(ts, "yyyy-MM-dd").alias("day"), F.concat_ws("\t", *parts).alias("value"))


def write_result_log(results: DataFrame, path: str, ts: str = "ts", as_json: bool = False) -> None:
    """Append to one folder per day."""
    result_log_lines(results, ts, as_json).write.mode("append").partitionBy("day").text(path)


def prediction_lines(probs: DataFrame, cols: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One line per row, probabilities tab-joined."""
    return probs.select(*keep, F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def write_predictions(probs: DataFrame, path: str, cols: list[str]) -> int:
    """Write the lines; raises if rows written differ from rows read, else returns their number."""
    from pyspark.sql import Observation
    read, wrote = Observation("read"), Observation("written")
    one = F.count(F.lit(1)).alias("n")
    prediction_lines(probs.observe(read, one), cols).observe(wrote, one).write.mode("overwrite").text(path)
    if read.get["n"] != wrote.get["n"]:
        raise ValueError(f"{wrote.get['n']} lines for {read.get['n']} rows")
    return wrote.get["n"]


def compare_report(df: DataFrame, keep: tuple[str, ...] = (), tags_only: bool = False) -> DataFrame:
    """O/X flags, gold and predicted labels, tokens and tags (joined by spaces).

    ``df`` has arrays ``tokens, tags, pred_tags, labels, pred_labels``.  The tag-only form has
    the slot flag, tokens and the two tag columns.
    """
    mark = lambda ok: F.when(ok, F.lit("O")).otherwise(F.lit("X"))
    slot = F.col("tags") == F.col("pred_tags")
    words = [F.array_join(c, " ").alias(c) for c in ("tokens", "tags", "pred_tags")]
    if tags_only:
        return df.select(*keep, mark(slot).alias("slot"), *words)
    intent = F.sort_array("labels") == F.sort_array("pred_labels")
    return df.select(*keep, mark(slot & intent).alias("frame"), mark(intent).alias("intent"), mark(slot).alias("slot"),
                     F.array_join("labels", ", ").alias("labels"), F.array_join("pred_labels", ", ").alias("pred_labels"), *words)


def write_compare_report(df: DataFrame, path: str, tags_only: bool = False) -> None:
    """Tab-separated with a header."""
    compare_report(df, tags_only=tags_only).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """``key = value``."""
    return metrics.select("key", F.concat_ws(" = ", "key", F.col("value").cast("string")).alias("value"))


def write_metrics(metrics: DataFrame, path: str, sort: bool = True) -> None:
    """The lines, sorted by key when asked."""
    m = metric_lines(metrics)
    (m.orderBy("key") if sort else m).select("value").coalesce(1).write.mode("overwrite").text(path)


def metrics_table(row: DataFrame) -> DataFrame:
    """Unpivot a one-row metrics result to ``(key, value)``."""
    cols = row.columns
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
                                          for c in cols])).alias("kv")).select("kv.key", "kv.value")


def write_features(df: DataFrame, path: str) -> None:
    """Encoded features as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Read back with int32 arrays."""
    f = spark.read.parquet(path)
    return f.select(*[F.col(c).cast("array<int>").alias(c) if c in ("input_ids", "input_mask", "segment_ids")
                      else F.col(c) for c in f.columns])


def read_text_file(spark: SparkSession, path: str) -> DataFrame:
    """Whole file as one string per file."""
    return spark.read.text(path, wholetext=True)


def write_lines(df: DataFrame, path: str, col: str = "value", append: bool = False) -> int:
    """Dump lines (overwrite or append); returns how many were written."""
    from pyspark.sql import Observation
    obs = Observation("lines")
    df.select(F.col(col).cast("string").alias("value")).observe(obs, F.count(F.lit(1)).alias("n")) \
        .write.mode("append" if append else "overwrite").text(path)
    return obs.get["n"]
