"""Round trips of the file readers and writers on temp folders."""
import os
import tempfile

from pyspark.sql import functions as F

from siftkit.operators.tokens import read_vocab
from siftkit.sources import files


def tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="siftkit-io-"), name)


def write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_tsv_examples_and_gold(spark):
    p = write(tmp("train.tsv"), "1\t好新聞\n0\t壞新聞\textra\n")
    ex = files.read_examples(spark, p, "binary", "train").orderBy("guid").collect()
    assert [(r.guid, r.text, r.labels) for r in ex] == [("train-0", "好新聞", ["1"]), ("train-1", "壞新聞", ["0"])]
    test = files.read_examples(spark, p, "comp", "test").orderBy("guid").collect()
    assert test[0].text == "1" and test[0].labels == ["0", "0", "0", "0"]
    g = write(tmp("gold.tsv"), "0\t王大明說\tx\t王大明,李四\n\n1\t無\tx\t\n")
    gold = files.read_gold_names(spark, g).orderBy("line_no").collect()
    assert [r.names for r in gold] == [["王大明", "李四"], [""]]
    s = write(tmp("slots.tsv"), "0\tt\tx\t店\t02\t路\t今天\n1\tshort\n")
    assert files.read_gold_slots(spark, s).count() == 1


def test_bio(spark):
    p = write(tmp("a.bio"), "-DOCSTART- O\n\n王 B_NAME\n大 I_NAME\n說 O\n\n李 B_NAME\n\n尾 O\n")
    rows = files.read_bio(spark, p).collect()
    assert [(r.labels, r.words) for r in rows] == [("B_NAME I_NAME O", "王 大 說"), ("B_NAME", "李")]


def test_vocab_label_map_thresholds_keywords(spark):
    v = write(tmp("vocab.txt"), "[PAD]\n[UNK]\n a \nb\na\n")
    got = {r.token: r.id for r in read_vocab(spark, v).collect()}
    assert got == {"[PAD]": 0, "[UNK]": 1, "a": 4, "b": 3}
    lm = tmp("label_map")
    files.write_label_map(spark.createDataFrame([(0, "'x'"), (1, "y")], "id int, label string"), lm)
    back = {r.id: r.label for r in files.read_label_map(spark, lm).collect()}
    assert back == {0: "x", 1: "y"}
    th = write(tmp("th.txt"), "0.3\nbad\n0.7\n")
    t = {r.class_id: r.threshold for r in files.read_thresholds(spark, th, 3).collect()}
    assert t == {0: 0.3, 1: 0.7, 2: 0.5}
    assert {r.threshold for r in files.read_thresholds(spark, None, 2).collect()} == {0.5}
    k = write(tmp("kw.txt"), "洗錢\n詐欺\n")
    assert [r.keyword for r in files.read_keywords(spark, k).collect()] == ["洗錢", "詐欺"]


def test_writers(spark):
    df = spark.createDataFrame([(0.2, 0.8), (0.6, 0.4)], "p0 double, p1 double")
    assert files.write_predictions(df, tmp("pred"), ["p0", "p1"]) == 2
    m = files.metrics_table(spark.createDataFrame([(0.5, 0.25)], "recall double, acc double"))
    out = tmp("metrics")
    files.write_metrics(m, out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines == ["acc = 0.25", "recall = 0.5"]
    feats = spark.createDataFrame([([1, 2], [1, 1], [0, 0])], "input_ids array<bigint>, input_mask array<bigint>, segment_ids array<bigint>")
    fp = tmp("feat")
    files.write_features(feats, fp)
    assert files.read_features(spark, fp).schema["input_ids"].dataType.simpleString() == "array<int>"
    assert files.write_lines(spark.createDataFrame([("a",), ("b",)], "value string"), tmp("lines")) == 2
    res = spark.createDataFrame([("甲乙", True, ["王"])], "article string, has_aml boolean, names array<string>") \
        .withColumn("ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    log = tmp("log")
    files.write_result_log(res, log)
    assert os.path.isdir(os.path.join(log, "day=2024-01-02"))
    j = tmp("posts.json")
    write(j, '[{"content": "甲。乙", "k": 1}, {"content": "丙"}]')
    assert files.read_json_list(spark, j).count() == 2
