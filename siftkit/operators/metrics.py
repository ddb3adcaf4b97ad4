"""Evaluation metrics (D7-D20) as aggregations.

Confusion matrices and per-class statistics are grouped by class ids, so
after map-side partial aggregation the shuffled data is one row per class
(pair) per partition, whatever the input size.  The threshold sweep (D14)
histograms scores into the threshold grid instead of joining every row to
every threshold.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_table

EPS = 1e-7


def safe_div(num, den) -> Column:
    """``num / den``, 0 when ``den`` is 0."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def f_beta(p, r, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return safe_div((1.0 + b2) * p * r, b2 * p + r)


def confusion_matrix(df: DataFrame, gold: str, pred: str, weight: str | None = None) -> DataFrame:
    """``(gold, pred, n)``, n = count or sum of weights; row = gold, column = prediction."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.sum(w).alias("n"))


def class_stats(cm: DataFrame) -> DataFrame:
    """Per class: diagonal, predicted total (column) and gold total (row) of a D7 matrix."""
    rows = F.explode(F.array(
        F.struct(F.col("gold").alias("c"), F.col("n").alias("g"), F.lit(0.0).alias("p"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0.0).alias("d")),
        F.struct(F.col("pred").alias("c"), F.lit(0.0).alias("g"), F.col("n").alias("p"), F.lit(0.0).alias("d"))))
    return cm.select(rows.alias("r")).groupBy(F.col("r.c").alias("cls")).agg(
        F.sum("r.d").alias("diag"), F.sum("r.p").alias("n_pred"), F.sum("r.g").alias("n_gold"))


def _listed(stats: DataFrame, pos: Sequence[int]) -> DataFrame:
    """Statistics of the listed classes; absent classes get zeros."""
    classes = stats.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(int(c)) for c in pos])).alias("cls"))
    return classes.join(stats, "cls", "left").na.fill(0.0, ["diag", "n_pred", "n_gold"])


def prf(cm: DataFrame, pos: Sequence[int], beta: float = 1.0, average: str = "micro") -> DataFrame:
    """Precision, recall and F-beta over the positive classes.

    micro: pooled diagonal / column and row totals; macro: plain mean of the
    per-class values over all listed classes; weighted: mean weighted by the
    gold count of each class.
    """
    st = _listed(class_stats(cm), pos)
    if average == "micro":
        agg = st.agg(F.sum("diag").alias("d"), F.sum("n_pred").alias("tp"), F.sum("n_gold").alias("tg"))
        p, r = safe_div(F.col("d"), F.col("tp")), safe_div(F.col("d"), F.col("tg"))
        return agg.select(p.alias("precision"), r.alias("recall"), f_beta(p, r, beta).alias("fbeta"))
    per = st.select("n_gold", safe_div(F.col("diag"), F.col("n_pred")).alias("p"),
                    safe_div(F.col("diag"), F.col("n_gold")).alias("r"))
    per = per.withColumn("f", f_beta(F.col("p"), F.col("r"), beta))
    if average == "macro":
        return per.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("fbeta"))
    if average == "weighted":
        n = F.sum("n_gold")
        return per.agg(safe_div(F.sum(F.col("p") * F.col("n_gold")), n).alias("precision"),
                       safe_div(F.sum(F.col("r") * F.col("n_gold")), n).alias("recall"),
                       safe_div(F.sum(F.col("f") * F.col("n_gold")), n).alias("fbeta"))
    raise ValueError(f"unknown average {average!r}")


def prf_present(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Macro P/R/F over classes present in gold or prediction, and accuracy (unweighted)."""
    st = class_stats(confusion_matrix(df, gold, pred))
    per = st.select("diag", "n_gold", safe_div(F.col("diag"), F.col("n_pred")).alias("p"),
                    safe_div(F.col("diag"), F.col("n_gold")).alias("r"))
    per = per.withColumn("f", safe_div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return per.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"),
                   safe_div(F.sum("diag"), F.sum("n_gold")).alias("accuracy"))


def accuracy(df: DataFrame, gold: str, pred: str, weight: str | None = None) -> DataFrame:
    """Weighted share of rows with ``gold == pred``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.agg(safe_div(F.sum(F.when(F.col(gold) == F.col(pred), w).otherwise(0.0)), F.sum(w)).alias("accuracy"))


def mean_loss(df: DataFrame, loss: str, weight: str | None = None) -> DataFrame:
    """Weighted mean of a loss column."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.agg(safe_div(F.sum(F.col(loss) * w), F.sum(w)).alias("mean_loss"))


def over_threshold(prob: Column, threshold: Column, strict: bool = False) -> Column:
    """``prob >= threshold`` (the extractor's rule) or ``>`` (the predict report's)."""
    return prob > threshold if strict else prob >= threshold


def grid_bucket(prob, n: int = 200) -> Column:
    """Number of grid thresholds strictly below ``prob`` (0..n).

    Threshold i is passed (``prob > t_i``) exactly when ``i < bucket``.
    """
    p = F.col(prob) if isinstance(prob, str) else prob
    inner = F.least(F.lit(n - 2), F.greatest(F.lit(0), F.ceil(p * (n - 1)) - 1))
    return (F.when(p > -EPS, 1).otherwise(0) + F.when(p > 0, inner).otherwise(0)
            + F.when(p > 1 + EPS, 1).otherwise(0)).cast("int")


def best_f1_threshold(df: DataFrame, cls: str, label: str, prob: str, n: int = 200,
                      weight: str | None = None, pooled: bool = True) -> DataFrame:
    """Best F1 over the threshold grid, per class and (``pooled``) over all classes.

    Positive when ``prob > t``; ``P = tp/(eps+tp+fp)``, ``R = tp/(eps+tp+fn)``,
    ``F = 2PR/(P+R+eps)``; the first (lowest) threshold wins ties.

    Rows are histogrammed into grid buckets (``grid_bucket``), so at most
    n+1 rows per class leave the map side.  tp and fp at threshold i are the
    weights of buckets above i, constant between two present buckets, so
    only threshold 0 and the present buckets are candidates; their suffix
    sums are a window over the small histogram.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    b = df.select(F.col(cls).alias("cls"), grid_bucket(prob, n).alias("b"),
                  (w * y).alias("pw"), (w * (1 - y)).alias("nw"))
    hist = b.groupBy("cls", "b").agg(F.sum("pw").alias("pw"), F.sum("nw").alias("nw"))
    if pooled:
        hist = hist.unionByName(hist.groupBy("b").agg(F.sum("pw").alias("pw"), F.sum("nw").alias("nw"))
                                .select(F.lit(None).cast(hist.schema["cls"].dataType).alias("cls"), "b", "pw", "nw"))
    zero = hist.select("cls").distinct().select("cls", F.lit(0).alias("b"), F.lit(0.0).alias("pw"),
                                                F.lit(0.0).alias("nw"))
    h = hist.unionByName(zero).groupBy("cls", "b").agg(F.sum("pw").alias("pw"), F.sum("nw").alias("nw"))
    above = Window.partitionBy("cls").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cls")
    h = h.select("cls", "b", F.coalesce(F.sum("pw").over(above), F.lit(0.0)).alias("tp"),
                 F.coalesce(F.sum("nw").over(above), F.lit(0.0)).alias("fp"),
                 F.sum("pw").over(whole).alias("tot"))
    h = h.filter(F.col("b") <= n - 1)
    eps = F.lit(EPS)
    p = F.col("tp") / (eps + F.col("tp") + F.col("fp"))
    r = F.col("tp") / (eps + F.col("tp") + (F.col("tot") - F.col("tp")))
    h = h.select("cls", "b", p.alias("precision"), r.alias("recall"))
    h = h.withColumn("best_f1", 2.0 * F.col("precision") * F.col("recall")
                     / (F.col("precision") + F.col("recall") + eps))
    first = Window.partitionBy("cls").orderBy(F.col("best_f1").desc(), F.col("b").asc())
    best = h.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") == 1)
    i = F.col("b")
    t = F.when(i == 0, F.lit(0.0 - EPS)).when(i == n - 1, F.lit(1.0 + EPS)).otherwise(i / float(n - 1))
    return best.select("cls", "best_f1", "precision", "recall", t.alias("threshold"))


def binary_prf(df: DataFrame, label: str, pred: str, group: str | None = None) -> DataFrame:
    """D15 piece: binary precision, recall, F1 of 0/1 columns (0 on empty denominators)."""
    y, q = F.col(label).cast("int"), F.col(pred).cast("int")
    aggs = [F.sum(y * q).alias("tp"), F.sum((1 - y) * q).alias("fp"), F.sum(y * (1 - q)).alias("fn")]
    g = df.rollup(group).agg(*aggs) if group else df.agg(*aggs)
    p = safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    cols = ([group] if group else []) + [p.alias("precision"), r.alias("recall"),
                                         safe_div(2 * p * r, p + r).alias("f1")]
    return g.select(*cols)


def auc_per_class(df: DataFrame, cls: str, label: str, prob: str) -> DataFrame:
    """Exact ROC AUC per class (Mann-Whitney with ties counted half).

    Rows are first reduced to one row per distinct (class, score) with
    positive and negative counts, range-partitioned by class and score.  The
    negatives ranked below a score are those of the class in earlier
    partitions (one sum a class and partition) plus a running sum within its
    own, so a class with many scores is not one task.
    """
    y = F.col(label).cast("double")
    d = df.groupBy(F.col(cls).alias("cls"), F.col(prob).alias("s")).agg(
        F.sum(y).alias("np"), F.sum(1 - y).alias("nn"))
    d = shared_table(d.repartitionByRange("cls", "s").withColumn("part", F.spark_partition_id()), "ranked-scores")
    earlier = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("cls", "part").agg(F.sum("nn").alias("n")).select(
        "cls", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)).alias("start"))
    own = Window.partitionBy("cls", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(starts, ["cls", "part"]).withColumn("below", F.col("start") + F.coalesce(F.sum("nn").over(own), F.lit(0.0)))
    a = d.groupBy("cls").agg(F.sum(F.col("np") * (F.col("below") + 0.5 * F.col("nn"))).alias("u"),
                             F.sum("np").alias("P"), F.sum("nn").alias("N"))
    return a.select("cls", safe_div(F.col("u"), F.col("P") * F.col("N")).alias("auc"))


def class_weights(labels: DataFrame, label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Balanced weights ``n / (n_classes * n_c)``; ``extra`` labels are counted once each."""
    x = labels.select(F.col(label).alias("label"))
    if extra:
        x = x.unionByName(labels.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(e) for e in extra])).alias("label")))
    counts = x.groupBy("label").agg(F.count("*").alias("n_c"))
    # one row per class: the totals over this small table need no shuffle of the input
    everything = Window.partitionBy()
    n, k = F.sum("n_c").over(everything), F.count("*").over(everything)
    return counts.select("label", (n / (k * F.col("n_c"))).alias("weight"))


def score_histogram(scores: DataFrame, score: str = "score", top: int = 4) -> DataFrame:
    """How many rows reach at least top, top-1, ..., 0 matching fields (cumulative)."""
    return scores.agg(*[F.sum(F.when(F.col(score) >= k, 1).otherwise(0)).alias(f"ge{k}")
                        for k in range(top, -1, -1)])
