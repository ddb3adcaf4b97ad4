"""Queries and SQL of scoring, training, decoding and evaluation with models."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import encoders as E
from ..operators import metrics as M
from ..session import shared_table
from ..sources import files as FI
from ..sources import fixtures
from ..sources.tables import table
from . import models as MD
from . import queries as Q
from . import screening
from .oracle import (ALL_SPANS_CTE, CHUNKS_CTE, KEYWORDS_CTE, LABELS_CTE, ORACLE, POSTS_CTE, SCREEN_CTES, TAGSEQ_CTE, _with, sentences_sql)
from .queries import r6, register

ALPHA = 0.5
CHUNK = ("doc_id", "chunk_idx")


# ---------------------------------------------------------------- K1: a model from outside, batch by batch
def letter_scorer(per_char: int, per_e: int, parts: int):
    """A deterministic model: a class probability from the text's length and its number of e."""
    def load():
        def predict(texts: np.ndarray) -> np.ndarray:
            k = np.array([(per_char * len(t) + per_e * t.count("e")) % parts for t in texts])
            return np.stack([(2 * k + 1) / (2 * parts), (2 * parts - 1 - 2 * k) / (2 * parts)], 1)
        return predict
    return load


def _letters_sql(text: str, per_char: int, per_e: int, parts: int) -> str:
    return f"({per_char} * length({text}) + {per_e} * (length({text}) - length(replace({text}, 'e', '')))) % {parts}"


CHUNK_SCORER, MENTION_SCORER = (7, 3, 100), (13, 5, 128)


@register("k1_score_text")
def q_score_text(spark, sf_dir):
    s = MD.score_batches(letter_scorer(*CHUNK_SCORER), Q.chunks(spark, sf_dir), "chunk")
    return s.select(*CHUNK, r6(F.col("p_pos")).alias("p_pos"), r6(F.col("p_neg")).alias("p_neg"))


ORACLE["k1_score_text"] = _with(CHUNKS_CTE) + f"""
SELECT doc_id, chunk_idx, round((2 * k + 1) / 200.0, 6) AS p_pos, round((199 - 2 * k) / 200.0, 6) AS p_neg
FROM (SELECT *, {_letters_sql('chunk', *CHUNK_SCORER)} AS k FROM chunks)"""


@register("k9_screen_by_batches")
def q_screen_by_batches(spark, sf_dir):
    """K9 over rows, chunks and mention sentences each scored in one pass of batches by a loaded model."""
    out = screening.screen_by_model(
        fixtures.articles(spark, sf_dir), lambda df: MD.score_batches(letter_scorer(*CHUNK_SCORER), df),
        lambda df: MD.score_batches(letter_scorer(*MENTION_SCORER), df), fixtures.keywords(spark, sf_dir), max_len=Q.CHUNK_LEN)
    return out.select("doc_id", "has_aml", "split_cnt", F.size("ner_names").alias("n_ner_names"),
                      Q.joined("ner_names").alias("ner_names"), Q.joined("names").alias("names"))


def _screen_sql() -> str:
    flagged = "(doc_id * 37 + chunk_idx * 11) % 100 AS k FROM chunks"
    mentioned = "(doc_id * 13 + chunk_idx * 7 + start0) % 128 AS k FROM occ"
    sql = ORACLE["k9_screen_articles"]
    assert sql.count(flagged) == 1 and sql.count(mentioned) == 1
    pair = _letters_sql("(name || '[SEP]' || sentence)", *MENTION_SCORER)
    return sql.replace(flagged, f"{_letters_sql('chunk', *CHUNK_SCORER)} AS k FROM chunks") \
        .replace(mentioned, f"{pair} AS k FROM ({sentences_sql('occ')})")


ORACLE["k9_screen_by_batches"] = _screen_sql()


# ---------------------------------------------------------------- K2: three classes, and several labels with thresholds
def held_out(df: DataFrame, key: str = "doc_id", parts: int = 5) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)) == 0


def three_classes(spark, sf_dir) -> DataFrame:
    """Texts with a class: 0 neither, 1 quality, 2 toxic."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 2.0).otherwise(F.col("quality").cast("double")).alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(lab, "doc_id")


@register("k2_three_classes")
def q_three_classes(spark, sf_dir):
    """K2 (rows-only): a multinomial model fitted on four fifths, every labelled text scored; the steps it took."""
    d = three_classes(spark, sf_dir)
    model = MD.train_text_classifier(d.where(~held_out(d)), num_features=1 << 14, reg=0.01)
    s = MD.class_probs(model, d).select("doc_id", held_out(d).alias("held_out"), F.col("label").cast("int").alias("gold"), "probs")
    best = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    return s.select("doc_id", "held_out", "gold", best.alias("pred"), *[r6(F.get("probs", i)).alias(f"p{i}") for i in range(3)],
                    F.lit(MD.iterations(model)).alias("iterations"))


@register("k2_label_models")
def q_label_models(spark, sf_dir):
    """K2 (rows-only): one model a label, the threshold of each by D14 on a held-out part, labels of every text."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(lab, "doc_id")
    models = MD.train_label_models(d.where(~held_out(d)), ["quality", "toxic"], num_features=1 << 14, reg=0.01)
    scores = shared_table(MD.label_scores(models, d), "label-scores")
    best = M.best_f1_threshold(scores.where(held_out(scores)), "cls", "gold", "prob", pooled=False)
    labels = MD.predict_labels(scores, best)
    gold = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    return lab.join(labels, "doc_id").select("doc_id", held_out(lab).alias("held_out"), Q.joined("labels").alias("labels"),
                                            F.array_join(gold, "|").alias("gold"))


# ---------------------------------------------------------------- K4, K5, I9 over the tags of the chunks
def decoder_sql(p: str, seq: str, train: str = "true", apply: str = "true", scale: float | None = MD.SCALE) -> str:
    """CTEs of a K3 model fitted on the rows ``(k, j, token, tag)`` of ``seq`` that satisfy ``train``, as whole numbers of
    1 / ``scale`` if given, and the sequences to apply it to: ``{p}q (k, j, e)``, one score a tag for each place."""
    whole = f"round({scale:.0f} * {{}})::BIGINT" if scale else "{}"
    never = f"{MD.NEVER * (1e3 if scale else 1):.0f}" + ("::BIGINT" if scale else "::DOUBLE")
    return f"""
{p}s AS (SELECT * FROM {seq} WHERE {train}),
{p}ec AS (SELECT tag, token, count(*) AS c FROM {p}s GROUP BY tag, token),
{p}g AS (SELECT tag, row_number() OVER (ORDER BY tag) AS i, sum(c) AS n, (SELECT count(DISTINCT token) FROM {p}s) AS nt FROM {p}ec GROUP BY tag),
{p}b AS (SELECT prev_tag, tag, count(*) AS c FROM (SELECT lag(tag) OVER (PARTITION BY k ORDER BY j) AS prev_tag, tag FROM {p}s)
         WHERE prev_tag IS NOT NULL GROUP BY prev_tag, tag),
{p}t AS (SELECT prev_tag, tag, {whole.format(f"ln((c + 1.0) / (sum(c) OVER (PARTITION BY prev_tag) + (SELECT count(*) FROM {p}g)))")} AS w FROM {p}b),
{p}m AS (SELECT list(w ORDER BY i) AS m FROM (
         SELECT b.i, list(coalesce(t.w, {never}) ORDER BY a.i) AS w FROM {p}g a CROSS JOIN {p}g b
         LEFT JOIN {p}t t ON t.prev_tag = a.tag AND t.tag = b.tag GROUP BY b.i)),
{p}e AS (SELECT token, list(w ORDER BY i) AS e FROM (
         SELECT x.token, g.i, coalesce({whole.format("ln((c.c + 1.0) / (g.n + g.nt))")}, {whole.format("ln(1.0 / (g.n + g.nt))")}) AS w
         FROM (SELECT DISTINCT token FROM {seq}) x CROSS JOIN {p}g g LEFT JOIN {p}ec c ON c.tag = g.tag AND c.token = x.token) GROUP BY token),
{p}st AS (SELECT list(CASE WHEN tag = '[CLS]' THEN 0 ELSE {never} END ORDER BY i) AS st FROM {p}g),
{p}q AS (SELECT k, j, e FROM {seq} JOIN {p}e USING (token) WHERE {apply})"""


def viterbi_sql(p: str) -> str:
    """CTE ``{p}path (k, path)``: the places of the best tags, one sign a place, found place by place; first best on ties."""
    return f"""
{p}v AS (
  SELECT k, j, list_transform(list_zip(st, e), lambda z: z[1] + z[2]) AS s, list_transform(range(1, len(e) + 1), lambda i: i::VARCHAR) AS path
  FROM {p}q, {p}st WHERE j = 0
  UNION ALL
  SELECT k, j, list_transform(list_zip(x, e), lambda z: list_max(z[1]) + z[2]),
         list_transform(list_zip(x, range(1, len(e) + 1)), lambda z: path[list_position(z[1], list_max(z[1]))] || z[2])
  FROM (SELECT q.k, q.j, q.e, v.path, list_transform(m, lambda c: list_transform(list_zip(v.s, c), lambda z: z[1] + z[2])) AS x
        FROM {p}v v JOIN {p}q q ON q.k = v.k AND q.j = v.j + 1, {p}m)),
{p}path AS (SELECT k, path[list_position(s, list_max(s))] AS path FROM (
            SELECT *, row_number() OVER (PARTITION BY k ORDER BY j DESC) AS last FROM {p}v) WHERE last = 1),
{p}dec AS (SELECT k, p.j, g.tag FROM (SELECT k, unnest(string_split(path, '')) AS c, generate_subscripts(string_split(path, ''), 1) - 1 AS j
                                      FROM {p}path) p JOIN {p}g g ON g.i = p.c::INT)"""


#: F4 tags of every chunk, with one key.
KEYED = "kseq AS (SELECT (doc_id, chunk_idx) AS k, doc_id, j, token, tag FROM seq)"
TAGS = (CHUNKS_CTE, ALL_SPANS_CTE, TAGSEQ_CTE, KEYED)


@register("k4_viterbi_decode")
def q_viterbi(spark, sf_dir):
    """K4: every chunk decoded with the K3 model of all chunks, in whole millionths."""
    seqs = Q.tag_blocks(spark, sf_dir)
    got = MD.fit_tagger(seqs, scale=MD.SCALE).decode(seqs, CHUNK)
    return got.select(*CHUNK, F.array_join("pred", " ").alias("tags"))


ORACLE["k4_viterbi_decode"] = _with(*TAGS, decoder_sql("h", "kseq"), viterbi_sql("h")) + """
SELECT k[1] AS doc_id, k[2] AS chunk_idx, string_agg(tag, ' ' ORDER BY j) AS tags FROM hdec GROUP BY k"""


def log_likelihoods(spark, sf_dir) -> DataFrame:
    seqs = Q.tag_blocks(spark, sf_dir)
    got = MD.fit_tagger(seqs).log_likelihoods(seqs, CHUNK)
    return got.select(*CHUNK, "score", (F.col("score") - F.col("z")).alias("log_likelihood"))


@register("k5_sequence_score")
def q_sequence_score(spark, sf_dir):
    return log_likelihoods(spark, sf_dir).select(*CHUNK, r6(F.col("score")).alias("score"))


@register("k5_log_likelihood")
def q_log_likelihood(spark, sf_dir):
    """K5: path score less the normaliser over all paths."""
    return log_likelihoods(spark, sf_dir).select(*CHUNK, r6(F.col("log_likelihood")).alias("log_likelihood"))


#: The normaliser by the forward sums, place by place, less which the path scores are log-likelihoods.
LIKELIHOOD_CTE = decoder_sql("f", "kseq", scale=None) + f""",
fa AS (
  SELECT k, j, list_transform(list_zip(st, e), lambda z: (z[1] + z[2])::DOUBLE) AS s FROM fq, fst WHERE j = 0
  UNION ALL
  SELECT k, j, list_transform(list_zip(x, e), lambda z: list_max(z[1]) + ln(list_sum(list_transform(z[1], lambda y: exp(y - list_max(z[1]))))) + z[2])
  FROM (SELECT q.k, q.j, q.e, list_transform(m, lambda c: list_transform(list_zip(a.s, c), lambda z: z[1] + z[2])) AS x
        FROM fa a JOIN fq q ON q.k = a.k AND q.j = a.j + 1, fm)),
fz AS (SELECT k, list_max(s) + ln(list_sum(list_transform(s, lambda y: exp(y - list_max(s))))) AS z FROM (
       SELECT *, row_number() OVER (PARTITION BY k ORDER BY j DESC) AS last FROM fa) WHERE last = 1),
ll AS (SELECT p.doc_id, p.chunk_idx, p.score, p.score - fz.z AS log_likelihood
       FROM ({{score}}) p JOIN fz ON fz.k = (p.doc_id, p.chunk_idx))"""
_SCORES = """
SELECT e.doc_id, e.chunk_idx, e.es + coalesce(t.ts, 0.0) AS score
FROM (SELECT doc_id, chunk_idx, sum(logp) AS es FROM seq JOIN em USING (tag, token) GROUP BY doc_id, chunk_idx) e
LEFT JOIN (SELECT doc_id, chunk_idx, sum(logp) AS ts FROM bi JOIN tr USING (prev_tag, tag) GROUP BY doc_id, chunk_idx) t USING (doc_id, chunk_idx)"""
_LIKELIHOODS = _with(*TAGS, LIKELIHOOD_CTE.replace("{score}", _SCORES))
ORACLE["k5_log_likelihood"] = _LIKELIHOODS + """
SELECT doc_id, chunk_idx, round(log_likelihood, 6) AS log_likelihood FROM ll"""


@register("i9_joint_loss")
def q_joint_loss(spark, sf_dir):
    """I9 of the K5 log-likelihoods, and of I5 as intent loss."""
    intent = Q.REGISTRY["i5_sigmoid_cross_entropy"](spark, sf_dir)
    return E.joint_loss(log_likelihoods(spark, sf_dir), "log_likelihood", intent, "loss", ALPHA).select(F.round("joint_loss", 3).alias("joint_loss"))


ORACLE["i9_joint_loss"] = _LIKELIHOODS + f"""
SELECT round({ALPHA} * (SELECT sum(-log_likelihood) FROM ll)
             + (1 - {ALPHA}) * (SELECT avg(loss) FROM ({ORACLE['i5_sigmoid_cross_entropy']})), 3) AS joint_loss"""


# ---------------------------------------------------------------- K12: a tagger trained, decoded and evaluated
def part_of(doc_id: str = "doc_id") -> Column:
    """Documents are dealt to train (three of five), dev and test."""
    k = F.col(doc_id) % 5
    return F.when(k == 3, F.lit("dev")).when(k == 4, F.lit("test")).otherwise(F.lit("train"))


def decoded_parts(spark, sf_dir) -> DataFrame:
    """``(part, doc_id, chunk_idx, tokens, tags, pred)`` of dev and test, K3 on train, K4, without the leading ``[CLS]``; written once."""
    seqs = Q.tag_blocks(spark, sf_dir).withColumn("part", part_of())
    model = MD.fit_tagger(seqs.where(F.col("part") == "train"), scale=MD.SCALE)
    apply = seqs.where(F.col("part") != "train")
    rest = lambda c: F.slice(c, F.lit(2), F.size(c)).alias(c)
    both = model.decode(apply, CHUNK, keep=("part", "tokens", "tags"))
    return shared_table(both.select("part", *CHUNK, rest("tokens"), rest("tags"), rest("pred")), "decoded-tags")


#: Classes of the tag metrics, those that count as positive, and the intents of a chunk.
TAG_IDS = {"B_NAME": 0, "I_NAME": 1, "O": 2, "[CLS]": 3}
POSITIVE = (0, 1)
INTENTS = ("name", "many")


def tag_pairs(d: DataFrame) -> DataFrame:
    ids = F.create_map(*[x for t, i in TAG_IDS.items() for x in (F.lit(t), F.lit(i))])
    one = F.explode(F.zip_with("tags", "pred", lambda a, b: F.struct(F.try_element_at(ids, a).alias("gold"), F.try_element_at(ids, b).alias("pred"))))
    return d.select("part", one.alias("x")).select("part", "x.gold", "x.pred")


def intent_scores(d: DataFrame) -> DataFrame:
    """``(part, doc_id, chunk_idx, cls, gold, prob)``: whether a chunk has a name, and at least five, by its gold tags;
    probabilities from the decoded ones, in hundredths."""
    count = lambda c, start: F.size(F.filter(c, lambda t: t.startswith(start)))
    x = d.select("part", *CHUNK, count("tags", "B_").alias("g"), count("pred", "B_").alias("b"), (count("pred", "B_") + count("pred", "I_")).alias("n"))
    each = F.explode(F.array(
        F.struct(F.lit(0).alias("cls"), (F.col("g") > 0).cast("int").alias("gold"), (F.least(F.lit(100), F.col("n") * 10) / 100.0).alias("prob")),
        F.struct(F.lit(1).alias("cls"), (F.col("g") >= 5).cast("int").alias("gold"), (F.least(F.lit(100), F.col("b") * 7) / 100.0).alias("prob"))))
    return x.select("part", *CHUNK, each.alias("x")).select("part", *CHUNK, "x.*")


def dev_thresholds(dev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D14 on the dev intents, and the thresholds as they are read back from the lines that A9 writes."""
    best = M.best_f1_threshold(dev, "cls", "gold", "prob")
    lines = best.where(F.col("cls").isNotNull()).select(F.col("cls").cast("long").alias("line_no"), F.col("threshold").cast("string").alias("value"))
    classes = dev.select(F.col("cls").alias("class_id")).distinct()
    return best, FI.parse_thresholds(lines, classes).select(F.col("class_id").alias("cls"), "threshold")


def evaluation(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The metric rows, and the A15 rows of the test part."""
    pairs, scores = tag_pairs(d), intent_scores(d)
    dev, test = pairs.where(F.col("part") == "dev"), pairs.where(F.col("part") == "test")
    best, thresholds = dev_thresholds(scores.where(F.col("part") == "dev"))
    judged = scores.where(F.col("part") == "test").join(F.broadcast(thresholds), "cls").withColumn("pred", (F.col("prob") > F.col("threshold")).cast("int"))
    name = F.get(F.array(*map(F.lit, INTENTS)), F.col("cls"))
    listed = lambda c, out: F.sort_array(F.collect_list(F.when(F.col(c) == 1, name))).alias(out)
    labels = judged.groupBy(*CHUNK).agg(listed("gold", "labels"), listed("pred", "pred_labels"))
    report = FI.compare_report(d.where(F.col("part") == "test").withColumnRenamed("pred", "pred_tags").join(labels, list(CHUNK)), CHUNK)
    rate = lambda c: F.avg((F.col(c) == "O").cast("double")).alias(f"{c}_rate")
    rows = [
        E.as_metrics(M.confusion_matrix(dev, "gold", "pred"), "dev", "confusion_matrix", ("gold", "pred"), ("n",)),
        E.as_metrics(M.prf(M.confusion_matrix(dev, "gold", "pred"), POSITIVE, 1.0, "macro"), "dev", "prf_macro", (), ("precision", "recall", "fbeta")),
        E.as_metrics(M.accuracy(dev, "gold", "pred"), "dev", "accuracy", (), ("accuracy",)),
        E.as_metrics(best, "dev", "best_f1", ("cls",), ("best_f1", "threshold")),
        E.as_metrics(M.prf_present(test, "gold", "pred"), "test", "prf_present", (), ("precision", "recall", "f1", "accuracy")),
        E.as_metrics(M.binary_prf(judged, "gold", "pred", "cls"), "test", "prf_per_class", ("cls",), ("precision", "recall", "f1")),
        E.as_metrics(report.agg(rate("intent"), rate("slot"), rate("frame")), "test", "compare", (), ("intent_rate", "slot_rate", "frame_rate")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out, report


@register("k12_evaluate_tagger")
def q_evaluate_tagger(spark, sf_dir):
    return evaluation(decoded_parts(spark, sf_dir))[0].withColumn("value", r6(F.col("value")) + 0.0)  # no negative zero


@register("k12_compare_report")
def q_compare_report(spark, sf_dir):
    r = evaluation(decoded_parts(spark, sf_dir))[1]
    return r.select(*CHUNK, "frame", "intent", "slot", "labels", "pred_labels", F.md5("tags").alias("tags"), F.md5("pred_tags").alias("pred_tags"))


EVALUATED = _with(*TAGS, decoder_sql("h", "kseq", "doc_id % 5 < 3", "doc_id % 5 >= 3"), viterbi_sql("h")) + f""",
ids AS (SELECT unnest(['{"', '".join(TAG_IDS)}']) AS tag, unnest({list(TAG_IDS.values())}) AS id),
pr AS (SELECT s.k, s.doc_id % 5 AS part, s.j, s.tag AS gtag, d.tag AS ptag, a.id AS gold, b.id AS pred
       FROM kseq s JOIN hdec d ON d.k = s.k AND d.j = s.j JOIN ids a ON a.tag = s.tag JOIN ids b ON b.tag = d.tag WHERE s.j > 0),
st AS (SELECT part, cls, sum(d) AS d, sum(p) AS p, sum(g) AS g FROM (
         SELECT part, gold AS cls, (gold = pred)::INT AS d, 0 AS p, 1 AS g FROM pr UNION ALL SELECT part, pred, 0, 1, 0 FROM pr) GROUP BY part, cls),
pc AS (SELECT part, cls, CASE WHEN p = 0 THEN 0 ELSE d / p END AS p, CASE WHEN g = 0 THEN 0 ELSE d / g END AS r FROM st),
every AS (SELECT k, part FROM (SELECT DISTINCT k, k[1] % 5 AS part FROM kseq WHERE doc_id % 5 >= 3)),
ct AS (SELECT e.k, e.part, count(*) FILTER (gtag = 'B_NAME') AS g, count(*) FILTER (ptag = 'B_NAME') AS b, count(*) FILTER (ptag IN ('B_NAME', 'I_NAME')) AS n,
              coalesce(bool_and(gtag = ptag), true) AS same, coalesce(string_agg(gtag, ' ' ORDER BY j), '') AS tags, coalesce(string_agg(ptag, ' ' ORDER BY j), '') AS ptags
       FROM every e LEFT JOIN pr ON pr.k = e.k GROUP BY e.k, e.part),
sc AS (SELECT k, part, 0 AS cls, (g > 0)::INT AS gold, least(100, n * 10) / 100.0::DOUBLE AS prob FROM ct
       UNION ALL SELECT k, part, 1, (g >= 5)::INT, least(100, b * 7) / 100.0::DOUBLE FROM ct),
grid AS (SELECT range AS i, CASE WHEN range = 0 THEN -1e-7 WHEN range = 199 THEN 1 + 1e-7 ELSE range / 199.0 END::DOUBLE AS t FROM range(200)),
sw AS (SELECT cls, i, t, tp / (1e-7 + tp + fp) AS p, tp / (1e-7 + tp + fn) AS r FROM (
         SELECT cls, i, t, sum((prob > t AND gold = 1)::INT)::DOUBLE AS tp, sum((prob > t AND gold = 0)::INT)::DOUBLE AS fp,
                sum((prob <= t AND gold = 1)::INT)::DOUBLE AS fn FROM sc, grid WHERE part = 3 GROUP BY GROUPING SETS ((cls, i, t), (i, t)))),
best AS (SELECT * FROM (SELECT *, 2.0 * p * r / (p + r + 1e-7) AS f, row_number() OVER (PARTITION BY cls ORDER BY 2.0 * p * r / (p + r + 1e-7) DESC, i) AS rn FROM sw) WHERE rn = 1),
ju AS (SELECT sc.*, (prob > t)::INT AS pred FROM sc JOIN best USING (cls) WHERE part = 4),
tb AS (SELECT cls, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM (
         SELECT cls, sum(gold * pred) AS tp, sum((1 - gold) * pred) AS fp, sum(gold * (1 - pred)) AS fn FROM ju GROUP BY GROUPING SETS ((cls), ()))),
lb AS (SELECT k, bool_and(gold = pred) AS same, coalesce(string_agg(CASE cls WHEN 0 THEN 'name' ELSE 'many' END, ', ' ORDER BY cls DESC) FILTER (gold = 1), '') AS labels,
              coalesce(string_agg(CASE cls WHEN 0 THEN 'name' ELSE 'many' END, ', ' ORDER BY cls DESC) FILTER (pred = 1), '') AS pred_labels FROM ju GROUP BY k),
rp AS (SELECT ct.k, CASE WHEN ct.same AND lb.same THEN 'O' ELSE 'X' END AS frame, CASE WHEN lb.same THEN 'O' ELSE 'X' END AS intent,
              CASE WHEN ct.same THEN 'O' ELSE 'X' END AS slot, labels, pred_labels, md5(tags) AS tags, md5(ptags) AS pred_tags
       FROM ct JOIN lb USING (k) WHERE part = 4),
f1 AS (SELECT part, cls, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pc),
tf AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM tb)"""

ORACLE["k12_evaluate_tagger"] = EVALUATED + """
SELECT part, metric, key, round(value, 6) + 0.0 AS value FROM (
SELECT 'dev' AS part, 'confusion_matrix.n' AS metric, gold || ',' || pred AS key, count(*)::DOUBLE AS value FROM pr WHERE part = 3 GROUP BY gold, pred
UNION ALL SELECT 'dev', unnest(['prf_macro.precision', 'prf_macro.recall', 'prf_macro.fbeta']), '', unnest([sum(p) / 2, sum(r) / 2, sum(f) / 2])
  FROM f1 WHERE part = 3 AND cls IN (0, 1)
UNION ALL SELECT 'dev', 'accuracy.accuracy', '', avg((gold = pred)::INT) FROM pr WHERE part = 3
UNION ALL SELECT 'dev', unnest(['best_f1.best_f1', 'best_f1.threshold']), coalesce(cls::VARCHAR, ''), unnest([f, t]) FROM best
UNION ALL SELECT 'test', unnest(['prf_present.precision', 'prf_present.recall', 'prf_present.f1', 'prf_present.accuracy']), '',
  unnest([avg(p), avg(r), avg(f), (SELECT avg((gold = pred)::INT) FROM pr WHERE part = 4)]) FROM f1 WHERE part = 4
UNION ALL SELECT 'test', unnest(['prf_per_class.precision', 'prf_per_class.recall', 'prf_per_class.f1']), coalesce(cls::VARCHAR, ''), unnest([p, r, f]) FROM tf
UNION ALL SELECT 'test', unnest(['compare.intent_rate', 'compare.slot_rate', 'compare.frame_rate']), '',
  unnest([avg((intent = 'O')::INT), avg((slot = 'O')::INT), avg((frame = 'O')::INT)]) FROM rp)"""

ORACLE["k12_compare_report"] = EVALUATED + """
SELECT k[1] AS doc_id, k[2] AS chunk_idx, frame, intent, slot, labels, pred_labels, tags, pred_tags FROM rp"""


# ---------------------------------------------------------------- K8 and K11: names of decoded tags against gold lines
@register("k11_evaluate_names")
def q_evaluate_names(spark, sf_dir):
    """Gold lines of the test part (A3), names by a tagger trained on the rest (K4, K8), matches (G1) and their rate."""
    seqs = Q.tag_blocks(spark, sf_dir).withColumn("part", part_of())
    one_line = F.regexp_replace("text", "[\\t\\n\\r]", " ")
    c = Q.chunks(spark, sf_dir).where(part_of() == "test").select(*CHUNK, F.col("chunk").alias("text"))
    gold = S.distinct_texts(S.bio_spans("tokens", "tags", " "), "NAME")
    lines = c.join(seqs.where(F.col("part") == "test").select(*CHUNK, gold.alias("names")), list(CHUNK)).select(
        F.struct(*CHUNK).alias("line_no"), F.concat_ws("\t", F.lit("0"), one_line, F.lit("x"), F.array_join("names", ",")).alias("value"))
    wanted = FI.parse_gold_names(lines).select("line_no.*", "names")
    model = MD.fit_tagger(seqs.where(F.col("part") != "test"), scale=MD.SCALE)
    test = seqs.where(F.col("part") == "test").select(*CHUNK, "tokens", "_block")
    pred = screening.names_of_tags(model.decode(test, CHUNK, keep=("tokens",)).join(c, list(CHUNK)), CHUNK, "tokens", "pred", "text")
    m = wanted.join(pred.withColumnRenamed("names", "pred"), list(CHUNK)).select(Q.is_match(F.col("pred"), F.col("names")).cast("double").alias("m"))
    return m.agg(r6(F.avg("m")).alias("accuracy"), F.sum("m").cast("long").alias("n_matched"), F.count("*").alias("n"))


def spans_sql(name: str, rows: str, sep: str = " ") -> str:
    """CTE ``{name}(k, kind, b, text)``: E2 over the rows ``(k, j, token, tag)``; only ``O`` and other tags neither end nor extend a span."""
    return f"""
{name}a AS (SELECT *, substr(tag, 3) AS kind FROM {rows} WHERE tag LIKE 'B\\_%' ESCAPE '\\' OR tag LIKE 'I\\_%' ESCAPE '\\'),
{name}b AS (SELECT *, sum((tag LIKE 'B%')::INT) OVER (PARTITION BY k ORDER BY j) AS opened, lag(kind) OVER (PARTITION BY k ORDER BY j) AS before FROM {name}a),
{name}c AS (SELECT *, sum((tag LIKE 'B%' OR kind IS DISTINCT FROM before)::INT) OVER (PARTITION BY k ORDER BY j) AS id FROM {name}b WHERE opened > 0),
{name} AS (SELECT k, kind, min(j) AS b, string_agg(replace(token, '#', ''), '{sep}' ORDER BY j) FILTER (replace(token, '#', '') <> '') AS text
           FROM {name}c GROUP BY k, kind, id HAVING text IS NOT NULL)"""


ORACLE["k11_evaluate_names"] = _with(
    *TAGS, decoder_sql("h", "kseq", "doc_id % 5 < 4", "doc_id % 5 = 4"), viterbi_sql("h"),
    "ptok AS (SELECT d.k, d.j, s.token, d.tag FROM hdec d JOIN kseq s ON s.k = d.k AND s.j = d.j)",
    spans_sql("gs", "(SELECT * FROM kseq WHERE doc_id % 5 = 4)"), spans_sql("ps", "ptok")) + """,
gn AS (SELECT k, list(text ORDER BY b) AS names FROM (SELECT k, text, min(b) AS b FROM gs GROUP BY k, text) GROUP BY k),
pn AS (SELECT k, list(text ORDER BY b) AS names FROM (SELECT k, text, min(b) AS b FROM ps GROUP BY k, text) GROUP BY k),
m AS (SELECT string_split(coalesce(array_to_string(gn.names, ','), ''), ',') AS gold, coalesce(pn.names, []) AS pred
      FROM (SELECT DISTINCT k FROM kseq WHERE doc_id % 5 = 4) e LEFT JOIN gn USING (k) LEFT JOIN pn USING (k))
SELECT round(avg(ok), 6) AS accuracy, sum(ok)::BIGINT AS n_matched, count(*) AS n
FROM (SELECT (len(pred) = len(gold) AND len(list_filter(pred, lambda x: NOT list_contains(gold, x))) = 0)::INT AS ok FROM m)"""


# ---------------------------------------------------------------- K10: place slots of decoded tags
LINE_END = "⏎"


def post_tokens(content: str | Column) -> Column:
    """Words of a post; its field words and line ends stand alone."""
    t = F.regexp_replace(content, "\n", f" {LINE_END} ")
    for word, _ in fixtures.FIELD_TAGS:
        t = F.replace(t, F.lit(word), F.lit(f" {word} "))
    return F.concat(F.array(F.lit("[CLS]")), F.filter(F.split(t, " "), lambda w: w != ""))


def post_tags(tokens: Column) -> Column:
    """Gold tags: a field word is ``L_x``, the words up to the line's end its ``B_x`` and ``I_x``, all else ``O``."""
    kinds = F.create_map(*[F.lit(x) for pair in fixtures.FIELD_TAGS for x in pair])

    def step(acc, w):
        kind = F.try_element_at(kinds, w)
        tag = (F.when(w == "[CLS]", w).when(kind.isNotNull(), F.concat(F.lit("L_"), kind)).when((w == LINE_END) | (acc["kind"] == ""), F.lit("O"))
               .when(acc["first"], F.concat(F.lit("B_"), acc["kind"])).otherwise(F.concat(F.lit("I_"), acc["kind"])))
        now = F.when(kind.isNotNull(), kind).when(w == LINE_END, F.lit("")).otherwise(acc["kind"])
        return F.struct(now.alias("kind"), kind.isNotNull().alias("first"), F.concat(acc["tags"], F.array(tag)).alias("tags"))

    init = F.struct(F.lit("").alias("kind"), F.lit(False).alias("first"), F.array().cast("array<string>").alias("tags"))
    return F.aggregate(tokens, init, step, lambda acc: acc["tags"])


@register("k10_extract_place_slots")
def q_place_slots(spark, sf_dir):
    """A tagger trained on four fifths of the F12 posts decodes all of them (K4), spans (E2), four fields."""
    p = shared_table(fixtures.posts(spark, sf_dir).select("post_id", post_tokens("content").alias("tokens")).withColumn(
        "tags", post_tags(F.col("tokens"))), "post-tokens")
    model = MD.fit_tagger(p.where(F.col("post_id") % 5 != 0), scale=MD.SCALE)
    tagged = p.select("post_id", "tokens").join(model.decode(p, ("post_id",)), "post_id")
    return screening.place_slots(tagged, "post_id", "tokens", "pred", " ")


_POST_TEXT = f"replace(content, chr(10), ' {LINE_END} ')"
for _word, _ in fixtures.FIELD_TAGS:
    _POST_TEXT = f"replace({_POST_TEXT}, '{_word}', ' {_word} ')"
ORACLE["k10_extract_place_slots"] = _with(
    POSTS_CTE, f"""
ptk AS (SELECT post_id AS k, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS j FROM (
        SELECT post_id, ['[CLS]'] || list_filter(string_split({_POST_TEXT}, ' '), lambda w: w <> '') AS l FROM posts)),
plb AS (SELECT *, CASE token {' '.join(f"WHEN '{w}' THEN '{k}'" for w, k in fixtures.FIELD_TAGS)} END AS kind FROM ptk),
pgr AS (SELECT *, sum((kind IS NOT NULL OR token = '{LINE_END}')::INT) OVER (PARTITION BY k ORDER BY j) AS grp FROM plb),
pgk AS (SELECT *, first_value(kind) OVER w AS own, row_number() OVER w AS nth FROM pgr WINDOW w AS (PARTITION BY k, grp ORDER BY j)),
pseq AS (SELECT k, j, token, CASE WHEN j = 0 THEN '[CLS]' WHEN grp = 0 OR own IS NULL THEN 'O' WHEN nth = 1 THEN 'L_' || own WHEN nth = 2 THEN 'B_' || own
                                  ELSE 'I_' || own END AS tag FROM pgk)""",
    decoder_sql("h", "pseq", "k % 5 <> 0"), viterbi_sql("h").replace("string_split(path, '')", "string_split(path, ',')").replace("|| z[2])", "|| ',' || z[2])"),
    "ptok AS (SELECT d.k, d.j, s.token, d.tag FROM hdec d JOIN pseq s ON s.k = d.k AND s.j = d.j)", spans_sql("ps", "ptok")) + """
SELECT p.post_id, coalesce(first(text ORDER BY b) FILTER (kind = 'STORE'), '') AS store, coalesce(first(text ORDER BY b) FILTER (kind = 'PHONE'), '') AS phone,
       coalesce(first(text ORDER BY b) FILTER (kind = 'ADDRESS'), '') AS address, coalesce(first(text ORDER BY b) FILTER (kind = 'TIME'), '') AS time
FROM posts p LEFT JOIN ps ON ps.k = p.post_id GROUP BY p.post_id"""
