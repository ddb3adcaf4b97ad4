"""Scoring and tagging models (K1-K5).

The reference's networks and weights are not public, so the jobs are
rebuilt with Spark-native estimators: a text classifier is a Spark ML
pipeline (K2), a tagger is estimated from tag counts as an HMM (K3) and
decoded with Viterbi (K4).  Model quality is not comparable to the
reference; the data flow is.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..session import shared_table

#: Log score of a transition that was never counted (times the scale of whole-number scores).
NEVER = -1e9


def train_text_classifier(df: DataFrame, text: str = "text", label: str = "label", num_features: int = 1 << 18,
                          max_iter: int = 100, reg: float = 0.0):
    """K2: ``RegexTokenizer -> HashingTF -> IDF -> LogisticRegression`` fitted on all labelled text.

    Two classes or more: labels are 0.0, 1.0, ...; more than two give a multinomial model.
    ``num_features`` hashed words and at most ``max_iter`` steps; ``iterations`` tells how many were used.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern="\\W+"),
              HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="_features"),
              LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg)]
    return Pipeline(stages=stages).fit(df)


def iterations(model) -> int:
    """Steps that a fitted text classifier took."""
    return model.stages[-1].summary.totalIterations


def class_probs(model, df: DataFrame) -> DataFrame:
    """K1: ``df`` with ``probs``, one probability a class, from a fitted pipeline."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).select(*df.columns, vector_to_array("probability").alias("probs"))


def score_text(model, df: DataFrame, positive: int = 1) -> DataFrame:
    """K1 for two classes: ``p_pos, p_neg``."""
    out = class_probs(model, df)
    return out.select(*df.columns, F.get("probs", positive).alias("p_pos"), F.get("probs", 1 - positive).alias("p_neg"))


def score_external(make_predict, df: DataFrame, text: str = "text", n_classes: int = 2, batch_size: int = 64) -> DataFrame:
    """K1 with a model from outside: ``make_predict()`` loads it once per Python process and returns
    ``texts -> array[n, n_classes]``; adds ``probs``."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return df.withColumn("probs", udf(F.col(text)))


def score_batches(make_predict, df: DataFrame, text: str = "text", batch_size: int = 64, positive: int = 0) -> DataFrame:
    """K1 for two classes with a model from outside: ``p_pos, p_neg``; a null text scores as an empty one."""
    out = score_external(make_predict, df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), "_text", 2, batch_size)
    return out.select(*df.columns, F.get("probs", positive).alias("p_pos"), F.get("probs", 1 - positive).alias("p_neg"))


def train_label_models(df: DataFrame, labels: list[str], text: str = "text", **options) -> dict:
    """K2 for several labels at once: one binary pipeline a label column, on the rows where it is not null."""
    return {c: train_text_classifier(df.filter(F.col(c).isNotNull()).withColumn("_label", F.col(c).cast("double")),
                                     text, "_label", **options) for c in labels}


def label_scores(models: dict, df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, cls, prob, gold)``: the probability of each label model for each row, and the label itself."""
    out = None
    for c, model in models.items():
        rows = score_text(model, df).select(key, F.lit(c).alias("cls"), F.col("p_pos").alias("prob"), F.col(c).alias("gold"))
        out = rows if out is None else out.unionByName(rows)
    return out


def predict_labels(scores: DataFrame, thresholds: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, labels)``: the labels whose probability is over their threshold (``(cls, threshold)``), in order."""
    over = scores.join(F.broadcast(thresholds.select("cls", "threshold")), "cls")  # a row a label
    kept = F.when(F.col("prob") > F.col("threshold"), F.col("cls"))
    return over.groupBy(key).agg(F.sort_array(F.collect_list(kept)).alias("labels"))


def tag_bigrams(tags) -> Column:
    """E5: neighbouring tags of a sequence as ``array<struct<prev_tag, tag>>``; empty below two tags."""
    t = F.col(tags) if isinstance(tags, str) else tags
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n),
                      lambda a, b: F.struct(a.alias("prev_tag"), b.alias("tag")))


def tag_counts(seqs: DataFrame, tokens: str = "tokens", tags: str = "tags") -> tuple[DataFrame, DataFrame]:
    """Counts ``(tag, token, n)`` and ``(prev_tag, tag, n)``, each made once and written to the shared folder."""
    pairs = seqs.select(F.explode(F.zip_with(tokens, tags, lambda w, t: F.struct(w.alias("token"), t.alias("tag")))).alias("p"))
    bigrams = seqs.select(F.explode(tag_bigrams(tags)).alias("b"))
    return (shared_table(pairs.groupBy(F.col("p.tag").alias("tag"), F.col("p.token").alias("token")).agg(F.count("*").alias("n")), "tag-tokens"),
            shared_table(bigrams.groupBy("b.prev_tag", "b.tag").agg(F.count("*").alias("n")), "tag-bigrams"))


def train_tagger(seqs: DataFrame, tokens: str = "tokens", tags: str = "tags"):
    """K3: HMM estimates from tag sequences: add-one smoothed log emissions and transitions.

    Returns ``(emissions(tag, token, logp), transitions(prev_tag, tag, logp), unseen(tag, logp))``;
    ``unseen`` is the smoothed score of a token never seen with the tag.
    """
    em, tr = tag_counts(seqs, tokens, tags)
    n_tokens, n_tags = em.select(F.countDistinct("token"), F.countDistinct("tag")).first()
    tag_tot = em.groupBy("tag").agg(F.sum("n").alias("n_tag"))
    emissions = em.join(F.broadcast(tag_tot), "tag").select(
        "tag", "token", F.log((F.col("n") + 1) / (F.col("n_tag") + n_tokens)).alias("logp"))
    prev_tot = tr.groupBy("prev_tag").agg(F.sum("n").alias("n_prev"))
    transitions = tr.join(F.broadcast(prev_tot), "prev_tag").select(
        "prev_tag", "tag", F.log((F.col("n") + 1) / (F.col("n_prev") + n_tags)).alias("logp"))
    unseen = tag_tot.select("tag", F.log(F.lit(1.0) / (F.col("n_tag") + n_tokens)).alias("logp"))
    return emissions, transitions, unseen


#: Tokens that a block of sequences holds, about; a task has one block at a time.
BLOCK_TOKENS = 2_000_000
#: Between the tokens of a sequence on its way to its block.
MARK = "\x1f"


def dealt_in_blocks(df: DataFrame, keys: tuple[str, ...], n_tokens: int) -> DataFrame:
    """The rows dealt by key into blocks of about BLOCK_TOKENS, ``_block`` its number; to be written before it is read."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_tokens // BLOCK_TOKENS))
    return df.repartition(parts, *keys).withColumn("_block", F.spark_partition_id())


def in_blocks(seqs: DataFrame, keys: tuple[str, ...], tokens: str = "tokens") -> DataFrame:
    """The sequences that have tokens, in blocks; written once."""
    seqs = seqs.where(F.size(tokens) > 0)
    return shared_table(dealt_in_blocks(seqs, keys, seqs.agg(F.sum(F.size(tokens))).first()[0] or 0), "sequence-blocks")


def over_emissions(seqs: DataFrame, emissions: DataFrame, unseen: DataFrame, tags: list[str], keys: tuple[str, ...], run, out: str,
                   kind: str, keep: tuple[str, ...] = (), tokens: str = "tokens", merged: bool = True) -> DataFrame:
    """``(*keys, *keep, out)``: ``run(matrices, table)`` over the log emissions (places times tags) of a block's sequences at once.

    A block sends each distinct token once to the table of emissions, and the rows of a block meet
    what comes back in one task.  ``merged``: sequences of equal keys are one, place by place.
    Without ``keep`` a row a key; with it a row a sequence, without those that have a null in their key.
    """
    fill = {r["tag"]: r["logp"] for r in unseen.collect()}  # one row a tag
    e = F.array(*[F.coalesce(F.max(F.when(F.col("tag") == t, F.col("logp"))), F.lit(fill[t])) for t in tags])
    vec = emissions.groupBy("token").agg(e.alias("e"))
    rows = seqs.select(*dict.fromkeys((*keys, *keep, tokens, "_block"))).where(F.size(tokens) > 0) if "_block" in seqs.columns else in_blocks(seqs.select(*dict.fromkeys((*keys, *keep, tokens))), keys, tokens)
    words = rows.select(F.col("_block").alias("_of"), F.col(tokens).alias("token")).mapInArrow(_distinct_words, "_of int, token string")
    words = words.repartition("token").distinct()  # the parts that the join wants
    known = words.join(vec, "token").select("_of", "token", "e")
    missing, k = np.array([[fill[t] for t in tags]]), len(tags)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in (*keys, *keep)]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        lists, table = pc.split_pattern(pc.coalesce(left.column("_text"), ""), MARK).combine_chunks(), right.combine_chunks()
        if left.column("_list").null_count < left.num_rows:
            lists = pa.array([b if a is None else a.split(MARK) for a, b in zip(left.column("_text").to_pylist(), left.column("_list").to_pylist())], pa.list_(pa.string()))
        vectors = np.concatenate([table.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k), missing])
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=table.column("token").combine_chunks()), len(vectors) - 1)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        each = np.split(vectors[at.to_numpy(zero_copy_only=False)], ends[:-1])
        group, first, of = {}, [], []
        for i, key in enumerate(zip(*(left.column(c).to_pylist() for c in keys))):
            if key not in group or not merged:
                group[key] = len(first)
                first.append([])
            of.append(group[key])
            first[-1 if not merged else group[key]].append(i)
        done = run([each[g[0]] if len(g) == 1 else _in_places([each[i] for i in g]) for g in first], left.take([g[0] for g in first]))
        if keep:
            whole = [i for i in range(len(of)) if all(left.column(c)[i].is_valid for c in keys)]
            left, done = left.take(pa.array(whole, pa.int64())), [done[of[i] if merged else i] for i in whole]
        else:
            left = left.take([g[0] for g in first])
        return pa.table([*(left.column(c) for c in (*keys, *keep)), pa.array(done, pa_kind)], names=[*keys, *keep, out])

    schema = ", ".join([*fields, f"{out} {kind}"])
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType
    pa_kind = to_arrow_type(StructType.fromDDL(f"{out} {kind}")[0].dataType)
    plain = ~F.exists(tokens, lambda w: w.isNull() | w.contains(MARK))
    sent = rows.select("_block", *dict.fromkeys((*keys, *keep)), F.when(plain, F.array_join(tokens, MARK)).alias("_text"),
                       F.when(~plain, F.col(tokens)).alias("_list"))
    return sent.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(block, schema)


def _distinct_words(batches):
    """The distinct tokens of each block in a batch of sequences."""
    for batch in batches:
        lists, of = batch.column("token"), batch.column("_of")
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = pa.table({"_of": of.take(pa.array(np.repeat(np.arange(len(n)), n))), "token": lists.flatten()})
        yield from flat.group_by(["_of", "token"]).aggregate([]).combine_chunks().to_batches()


def _in_places(ems: list[np.ndarray]) -> np.ndarray:
    """Several sequences as one, place by place; at a place by their scores."""
    e, at = np.concatenate(ems), np.concatenate([np.arange(len(x)) for x in ems])
    return e[np.lexsort((*e.T[::-1], at))]


def emission_rows(seqs: DataFrame, emissions: DataFrame, unseen: DataFrame, tags: list[str],
                  keys: tuple[str, ...] = ("doc_id", "chunk_idx"), tokens: str = "tokens") -> DataFrame:
    """``(*keys, flat)``: each sequence's log emissions, one after the other for every position and tag of ``tags``."""
    return over_emissions(seqs, emissions, unseen, tags, keys, lambda ems, _: [x.ravel() for x in ems], "flat", "array<double>", tokens=tokens)


def tag_matrix(transitions: DataFrame, tags: list[str], start: str, never: float = NEVER) -> tuple[np.ndarray, np.ndarray]:
    """Log transition matrix and start scores; of the tag set squared, read once."""
    at = {t: i for i, t in enumerate(tags)}
    matrix = [[never] * len(tags) for _ in tags]
    for r in transitions.collect():
        matrix[at[r["prev_tag"]]][at[r["tag"]]] = r["logp"]
    return np.array(matrix), np.array([0.0 if t == start else never for t in tags])


#: Scores in whole millionths: sums are exact, so ties are ties in every engine.
SCALE = 1e6


@dataclass(frozen=True)
class Tagger:
    """A K3 model: its tags in order, transition matrix and start scores, and the tables of emissions."""
    tags: list[str]
    matrix: np.ndarray
    start: np.ndarray
    emissions: DataFrame
    unseen: DataFrame

    def emission_rows(self, seqs: DataFrame, keys: tuple[str, ...], tokens: str = "tokens") -> DataFrame:
        return emission_rows(seqs, self.emissions, self.unseen, self.tags, keys, tokens)

    def over_emissions(self, seqs: DataFrame, keys: tuple[str, ...], run, out: str, kind: str, **how) -> DataFrame:
        return over_emissions(seqs, self.emissions, self.unseen, self.tags, keys, run, out, kind, **how)

    def decode(self, seqs: DataFrame, keys: tuple[str, ...], tokens: str = "tokens", keep: tuple[str, ...] = ()) -> DataFrame:
        """K4: ``(*keys, *keep, pred)``, the best tags of each sequence, the first best on ties."""
        best = viterbi_all(self.matrix, self.start)
        paths = self.over_emissions(seqs, keys, lambda ems, _: best(ems), "path", "array<int>", keep=keep, tokens=tokens)
        names = F.array(*[F.lit(t) for t in self.tags])
        return paths.select(*keys, *keep, F.transform("path", lambda i: F.get(names, i)).alias("pred"))

    def log_likelihoods(self, seqs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """K5: ``(*keys, score, z)``, the score of each sequence's own ``tags`` and the normaliser over all paths.

        One pass over the emissions gives both.
        """
        forward, matrix, at = normaliser_all(self.matrix, self.start), self.matrix, F.create_map(*[x for i, t in enumerate(self.tags) for x in (F.lit(t), F.lit(i))])

        def score(em: np.ndarray, own: list[int]) -> float:
            path = np.array(own)
            return float(em[np.arange(len(em)), path].sum() + matrix[path[:-1], path[1:]].sum())

        def both(ems, rows) -> list[list[float]]:
            return [[score(em, own), z] for em, own, z in zip(ems, rows.column("own").to_pylist(), forward(ems))]

        own = seqs.withColumn("own", F.transform("tags", lambda t: F.try_element_at(at, t)))
        done = self.over_emissions(own, keys, both, "r", "array<double>", keep=("own",), merged=False)
        return done.select(*keys, F.get("r", 0).alias("score"), F.get("r", 1).alias("z"))


def fit_tagger(seqs: DataFrame, start: str = "[CLS]", scale: float | None = None) -> Tagger:
    """K3 as a ``Tagger``; with ``scale``, log scores are rounded to whole numbers of that part."""
    parts = train_tagger(seqs)
    if scale:
        parts = [p.withColumn("logp", F.round(F.col("logp") * scale)) for p in parts]
    emissions, transitions, unseen = parts
    tags = sorted(r["tag"] for r in unseen.select("tag").collect())  # the tag set bounds the model
    return Tagger(tags, *tag_matrix(transitions, tags, start, NEVER * (1e3 if scale else 1)), emissions, unseen)


def normaliser_udf(transitions: np.ndarray, start: np.ndarray):
    """K5: log of the summed scores of all paths (forward algorithm), for flattened emission matrices as K4's."""
    return _over_column(normaliser(np.asarray(transitions, dtype=float), np.asarray(start, dtype=float)), DoubleType())


def normaliser(trans: np.ndarray, st: np.ndarray):
    """The forward algorithm over one flattened emission matrix."""
    every = normaliser_all(trans, st)
    return lambda flat: every([flat])[0]


def normaliser_all(trans: np.ndarray, st: np.ndarray):
    """The forward algorithm over many emission matrices, one numpy step a position for all of them; 0 for an empty one."""
    def run(ems: list[np.ndarray]) -> list[float]:
        padded, _, alive = padded_run(ems)
        score = st + padded[:, 0]
        for i in range(1, padded.shape[1]):
            n = alive[i]
            cand = score[:n, :, None] + trans
            top = cand.max(axis=1)
            score[:n] = top + np.log(np.exp(cand - top[:, None, :]).sum(axis=1)) + padded[:n, i]
        top = score.max(axis=1)
        return (top + np.log(np.exp(score - top[:, None]).sum(axis=1))).tolist()

    return by_length(run, trans.shape[0], 0.0)


def viterbi_udf(transitions: np.ndarray, start: np.ndarray):
    """K4: Viterbi over per-sequence emission matrices (flattened, ``n x T``), one Arrow batch at a time.

    ``transitions`` is ``T x T`` (log), ``start`` the log scores of the first
    position; both are small and travel with the function.  Returns the best
    tag index per position, first best on ties.
    """
    trans = np.asarray(transitions, dtype=float)
    st = np.asarray(start, dtype=float)
    return _over_column(viterbi(trans, st), ArrayType(IntegerType()))


def viterbi(trans: np.ndarray, st: np.ndarray):
    """The decoder of one flattened emission matrix."""
    every = viterbi_all(trans, st)
    return lambda flat: every([flat])[0]


#: Emissions (positions times tags) that one step of the batched decoder holds at a time.
HELD = 4_000_000


def padded_run(ems: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices, longest first, as one padded array; their lengths; how many are longer than each position."""
    lengths = np.array([len(e) for e in ems])
    padded = np.zeros((len(ems), lengths[0], ems[0].shape[1]))
    for row, e in zip(padded, ems):
        row[:len(e)] = e
    return padded, lengths, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def by_length(run, k: int, empty):
    """``run`` over many flattened emission matrices of ``k`` tags, and ``empty`` for one without places.

    The sequences go through sorted by length, longest first, in runs of at most HELD emissions
    as padded, so those that still have a position are always the first rows.
    """
    def each(flats) -> list:
        ems = [np.asarray(f, dtype=float).reshape(-1, k) for f in flats]
        order = sorted((i for i, e in enumerate(ems) if len(e)), key=lambda i: -len(ems[i]))
        out: list = [empty for _ in ems]
        while order:
            n = max(1, HELD // (len(ems[order[0]]) * k))
            now, order = order[:n], order[n:]
            for i, got in zip(now, run([ems[i] for i in now])):
                out[i] = got
        return out

    return each


def viterbi_all(trans: np.ndarray, st: np.ndarray):
    """The decoder of many flattened emission matrices, one numpy step a position for all of them."""
    def run(ems: list[np.ndarray]) -> list[list[int]]:
        padded, lengths, alive = padded_run(ems)
        back = np.zeros(padded.shape, np.int32)
        score = st + padded[:, 0]
        for i in range(1, lengths[0]):
            n = alive[i]
            cand = score[:n, :, None] + trans
            best = np.argmax(cand, axis=1)
            back[:n, i] = best
            score[:n] = np.take_along_axis(cand, best[:, None, :], 1)[:, 0] + padded[:n, i]
        at, paths = np.argmax(score, axis=1), np.zeros(padded.shape[:2], np.int32)
        for i in range(lengths[0] - 1, -1, -1):
            n = alive[i]
            paths[:n, i] = at[:n]
            if i:
                at[:n] = back[np.arange(n), i, at[:n]]
        return [path[:n].tolist() for path, n in zip(paths, lengths)]

    return by_length(run, trans.shape[0], [])


def _over_column(one, kind):
    @F.pandas_udf(kind)
    def run(col: pd.Series) -> pd.Series:
        return col.map(one)

    return run


def path_score(emission_sum: Column, transition_sum: Column) -> Column:
    """K5: score of a given path = summed emissions + summed transitions."""
    return emission_sum + transition_sum
