"""Queries and SQL of the encoders, label maps, losses and evaluation compositions."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import requests as RQ
from ..functions import spans as S
from ..functions import text as T
from ..operators import encoders as E
from ..operators import metrics as M
from ..operators import tokens as TK
from ..operators import wordpiece as WP
from ..session import shared_dir, shared_table
from ..sources import fixtures
from ..sources.tables import table
from . import queries as Q
from . import screening
from .oracle import (ALL_SPANS_CTE, CHUNKS_CTE, H5_EXPR, LABELS_CTE, ML_CTE, ORACLE, PAIRS_TURN_CTE, POSTS_CTE, VOCAB_CTE, VOCAB_ONLY_CTE,
                     WORDPIECE_CTE, _with)
from .queries import register

TAGGER_LEN = 512


def as_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


# ---------------------------------------------------------------- lookups and encoders
@register("c1_tokens_to_ids")
def q_tokens_to_ids(spark, sf_dir):
    d = Q.docs(spark, sf_dir).select("doc_id", T.basic_tokens("text").alias("tokens"))
    ids = TK.tokens_to_ids(d, Q.vocab(spark, sf_dir), unk_id=TK.SPECIAL_TOKENS.index("[UNK]"))
    return ids.select("doc_id", F.size("ids").alias("n"), F.md5(as_text(F.col("ids"))).alias("h"))


ORACLE["c1_tokens_to_ids"] = _with(VOCAB_CTE) + """
SELECT d.doc_id, CAST(coalesce(x.n, 0) AS INT) AS n, md5(coalesce(x.ids, '')) AS h FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY pos) AS ids FROM (
    SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM dtoks) t LEFT JOIN vocab v USING (token)
  GROUP BY doc_id) x USING (doc_id)"""


@register("c3_map_labels")
def q_map_labels(spark, sf_dir):
    lab = Q.parsed_labels(spark, sf_dir).select("doc_id", "labels")
    m = Q.label_map(spark, sf_dir)
    ids = E.map_labels(lab, m, "labels", "label", "id", "doc_id")
    back = E.map_labels(ids.select("doc_id", F.col("mapped").alias("ids")), m, "ids", "id", "label", "doc_id")
    return ids.select("doc_id", as_text(F.col("mapped")).alias("ids")).join(
        back.select("doc_id", Q.joined("mapped").alias("labels")), "doc_id")


ORACLE["c3_map_labels"] = _with(LABELS_CTE) + """
SELECT doc_id, string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY pos) AS ids, string_agg(p.label, '|' ORDER BY pos) AS labels
FROM (SELECT doc_id, unnest(labels) AS label, generate_subscripts(labels, 1) AS pos FROM plabels) p JOIN lmap m USING (label)
GROUP BY doc_id"""


@register("j2_encode_pair")
def q_encode_pair(spark, sf_dir):
    p = Q.turn_pairs(spark, sf_dir).select("conv_id", "turn", T.basic_tokens("a").alias("ta"), T.basic_tokens("b").alias("tb"))
    cls, sep = (TK.SPECIAL_TOKENS.index(x) for x in ("[CLS]", "[SEP]"))
    shared = Q.corpus_vocab(spark, sf_dir)[1]
    e = WP.with_flat_ids(p, {"ta": "a", "tb": "b"}, shared).select(
        "conv_id", "turn", E.encode_pair("a", "b", cls, sep, Q.NAME_PAIR_LEN).alias("e"))
    return e.select("conv_id", "turn", as_text(F.col("e.input_ids")).alias("input_ids"),
                    as_text(F.col("e.input_mask")).alias("input_mask"), as_text(F.col("e.segment_ids")).alias("segment_ids"))


def pieces_sql(name: str, rows: str) -> str:
    """CTEs ``{name}(k, ids)``: the piece ids of the token lists in ``rows`` (columns k, toks), empty where there are none."""
    return f"""{VOCAB_ONLY_CTE},
t_rows AS ({rows}),
t_each AS (SELECT k, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM t_rows),
utoks AS (SELECT DISTINCT token FROM t_each), {WORDPIECE_CTE},
{name} AS (SELECT t_rows.k, coalesce(any_value(g.ids), []) AS ids FROM t_rows
           LEFT JOIN (SELECT k, flatten(list(w.ids ORDER BY pos)) AS ids FROM t_each JOIN wp_ids w USING (token) GROUP BY k) g ON g.k = t_rows.k
           GROUP BY t_rows.k)"""


ORACLE["j2_encode_pair"] = f"""
{_with(PAIRS_TURN_CTE, pieces_sql("pc", "SELECT (conv_id, turn, 'a') AS k, ta AS toks FROM tt UNION ALL SELECT (conv_id, turn, 'b'), tb FROM tt"))},
p AS (SELECT tt.conv_id, tt.turn, a.ids AS ia, b.ids AS ib, len(a.ids) AS la, len(b.ids) AS lb
      FROM tt JOIN pc a ON a.k = (conv_id, turn, 'a') JOIN pc b ON b.k = (conv_id, turn, 'b')),
c AS (SELECT *, CASE WHEN la + lb > 47 THEN least(la, greatest(24, 47 - lb)) ELSE la END AS na,
             CASE WHEN la + lb > 47 THEN least(lb, greatest(23, 47 - la)) ELSE lb END AS nb FROM p),
z AS (SELECT conv_id, turn, na, nb, [2] || list_slice(ia, 1, na) || [3] || list_slice(ib, 1, nb) || [3] AS ids FROM c)
SELECT conv_id, turn, array_to_string(ids || list_transform(range(50 - len(ids)), lambda i: 0), ',') AS input_ids,
       array_to_string(list_transform(range(50), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS input_mask,
       array_to_string(list_transform(range(50), lambda i: CASE WHEN i >= na + 2 AND i < na + nb + 3 THEN 1 ELSE 0 END), ',') AS segment_ids
FROM z"""


@register("j4_encode_tagger")
def q_encode_tagger(spark, sf_dir):
    ids = TK.doc_piece_ids(Q.chunks(spark, sf_dir), T.basic_tokens("chunk"), Q.corpus_vocab(spark, sf_dir)[1], keys=("doc_id", "chunk_idx"))
    cls = F.lit(TK.SPECIAL_TOKENS.index("[CLS]"))
    e = ids.select("doc_id", "chunk_idx", TK.encode_ids("ids", cls, cls, TAGGER_LEN, with_sep=False).alias("e"))
    return e.select("doc_id", "chunk_idx", F.md5(as_text(F.col("e.input_ids"))).alias("h"),
                    F.aggregate("e.input_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.size("e.segment_ids").alias("n_segments"))


ORACLE["j4_encode_tagger"] = f"""
{_with(CHUNKS_CTE, pieces_sql("pc", f"SELECT (doc_id, chunk_idx) AS k, {H5_EXPR.replace('text', 'chunk')} AS toks FROM chunks"))},
e AS (SELECT doc_id, chunk_idx, [2] || list_slice(ids, 1, 511) AS body FROM chunks JOIN pc ON pc.k = (doc_id, chunk_idx))
SELECT doc_id, chunk_idx, md5(array_to_string(body || list_transform(range(512 - len(body)), lambda i: 0), ',')) AS h,
       CAST(len(body) AS INT) AS n_real, CAST(512 AS INT) AS n_segments FROM e"""


@register("j5_align_tags")
def q_align_tags(spark, sf_dir):
    """F4 tags on pieces; tag ids are E4 over the tags."""
    c = shared_table(Q.tag_sequences(spark, sf_dir), "tag-sequences")
    tag = shared_table(c.select(F.explode("tags").alias("tag")).distinct(), "tags")
    ids = tag.select("tag", (F.row_number().over(Window.orderBy("tag")) - 1).alias("id"))  # a row a tag
    body = c.select("doc_id", "chunk_idx", *(F.slice(x, F.lit(2), F.size(x)).alias(x) for x in ("tokens", "tags")))
    a = E.align_tags(body, Q.corpus_vocab(spark, sf_dir)[1], ids, T.word_tokens, TAGGER_LEN, TK.SPECIAL_TOKENS.index("[CLS]"))
    return a.select("doc_id", "chunk_idx", "n_real", F.md5(as_text(F.col("input_ids"))).alias("input_ids"),
                    as_text(F.slice("tag_ids", F.lit(1), F.col("n_real") + 2)).alias("tag_ids"))


ORACLE["j5_align_tags"] = f"""
{_with(CHUNKS_CTE, ALL_SPANS_CTE, pieces_sql("pc", f"SELECT (doc_id, chunk_idx, j) AS k, {H5_EXPR.replace('text', 'tok')} AS toks FROM atagged"))},
tag_ids AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS id FROM (SELECT DISTINCT tag FROM atagged UNION SELECT '[CLS]')),
p AS (SELECT doc_id, chunk_idx, j, tag, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM atagged JOIN pc ON pc.k = (doc_id, chunk_idx, j)),
q AS (SELECT p.doc_id, p.chunk_idx, list(p.id ORDER BY j, i) AS ids, list(t.id ORDER BY j, i) AS tags
      FROM p JOIN tag_ids t ON t.tag = CASE WHEN i = 1 THEN p.tag ELSE 'O' END GROUP BY p.doc_id, p.chunk_idx),
b AS (SELECT c.doc_id, c.chunk_idx, [2] || list_slice(coalesce(ids, []), 1, 511) AS ids,
             [(SELECT id FROM tag_ids WHERE tag = '[CLS]')] || list_slice(coalesce(tags, []), 1, 511) AS tags
      FROM chunks c LEFT JOIN q USING (doc_id, chunk_idx))
SELECT doc_id, chunk_idx, CAST(len(ids) AS INT) AS n_real, md5(array_to_string(ids || list_transform(range(512 - len(ids)), lambda i: 0), ',')) AS input_ids,
       array_to_string(list_slice(tags || [(SELECT id FROM tag_ids WHERE tag = 'O'), (SELECT id FROM tag_ids WHERE tag = 'O')], 1, 512), ',') AS tag_ids FROM b"""


@register("h16_pair_full_text")
def q_pair_full_text(spark, sf_dir):
    """H16 for the first F5 name of each document, scored by F3."""
    n = Q.doc_names(spark, sf_dir).filter(F.size("names") > 0).select("doc_id", F.get("names", 0).alias("name"))
    x = Q.docs(spark, sf_dir).join(n, "doc_id").withColumn("pair", screening.full_text_pair("text", "name", Q.NAME_PAIR_LEN))
    s = fixtures.chunk_score(F.col("doc_id"), F.lit(0))
    return x.select("doc_id", "pair", (s["p_pos"] > s["p_neg"]).alias("keep"))


ORACLE["h16_pair_full_text"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """,
f AS (SELECT doc_id, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, span_idx) AS rn FROM names5) WHERE rn = 1)
SELECT d.doc_id, substring(d.text, 1, 40) || '[SEP]' || f.name AS pair, 2 * k + 1 > 199 - 2 * k AS keep
FROM (SELECT *, doc_id * 37 % 100 AS k FROM documents) d JOIN f USING (doc_id)"""


# ---------------------------------------------------------------- small functions
@register("h27_to_unicode")
def q_to_unicode(spark, sf_dir):
    """H27 over texts with an invalid byte put into their middle."""
    d = Q.docs(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    raw = F.concat(F.substring("text", F.lit(1), half).cast("binary"), F.lit(b"\xff"),
                   F.col("text").substr(half + 1, F.length("text")).cast("binary"))
    return d.select("doc_id", F.md5(T.to_unicode(raw)).alias("h"))


ORACLE["h27_to_unicode"] = "SELECT doc_id, md5(text) AS h FROM documents"


@register("j11_result_json")
def q_result_json(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", RQ.result_json({"text": F.col("text"), "lang": F.col("lang"), "doc_id": F.col("doc_id")}).alias("json"))


ORACLE["j11_result_json"] = "SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'text': text})::VARCHAR AS json FROM documents"


@register("j13_answer_status")
def q_answer_status(spark, sf_dir):
    """The parsed request's words as answer; a broken request has none and makes an error row."""
    p = Q.parsed_requests(spark, sf_dir)
    answer = F.split(F.col("req.news"), " ")
    return p.select("doc_id", RQ.answer_status(answer).alias("status"), F.coalesce(F.size(answer), F.lit(0)).alias("n"))


ORACLE["j13_answer_status"] = f"""
SELECT doc_id, CASE WHEN news IS NULL THEN 'error' ELSE 'ok' END AS status,
       CAST(CASE WHEN news IS NULL THEN 0 ELSE len(string_split(news, ' ')) END AS INT) AS n
FROM ({ORACLE['j12_parse_request'].replace('SELECT doc_id, ts, id, length(news) AS news_len FROM parsed', 'SELECT doc_id, news FROM parsed')})"""


@register("b7_first_slot")
def q_first_slot(spark, sf_dir):
    p = fixtures.posts(spark, sf_dir).select("post_id", E.line_tagger(fixtures.FIELD_TAGS)(F.col("content")).alias("t"))
    slots = p.select("post_id", S.slot_map(S.bio_spans("t.tokens", "t.tags")).alias("m"))
    return slots.select("post_id", S.first_slot("m", "PHONE").alias("phone"), S.first_slot("m", "NONE").alias("none"))


ORACLE["b7_first_slot"] = _with(POSTS_CTE) + """
SELECT post_id, replace(regexp_extract(content, '(?m)^電話：.*$'), '#', '') AS phone, '' AS none FROM posts"""


@register("i8_threshold_grid")
def q_threshold_grid(spark, sf_dir):
    """I8 as used: how many F8 scores of each class lie over each grid point."""
    s = fixtures.multilabel_scores(spark, sf_dir)
    g = s.select("cls", M.grid_bucket(F.col("prob")).alias("k")).groupBy("cls", "k").agg(F.count("*").alias("n"))
    return g.select("cls", "k", "n")


ORACLE["i8_threshold_grid"] = _with(ML_CTE) + """
SELECT cls, CAST((SELECT count(*) FROM range(200) r(i)
                  WHERE prob > CASE WHEN i = 0 THEN -1e-7 WHEN i = 199 THEN 1 + 1e-7 ELSE i / 199.0::DOUBLE END) AS INT) AS k, count(*) AS n
FROM ml GROUP BY 1, 2"""


# ---------------------------------------------------------------- file formats, on lines derived from the tables
from ..sources import files as FI  # noqa: E402

ONE_LINE = "regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')"


def labelled_lines(spark, sf_dir) -> DataFrame:
    """Lines ``lang, text, [lang, source], source`` per document; every row whole, line number = doc_id."""
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace("text", "[\\t\\n\\r]", " ")
    return d.select(F.col("doc_id").alias("line_no"), F.concat_ws(
        "\t", "lang", text, F.concat(F.lit("["), "lang", F.lit(", "), "source", F.lit("]")), F.concat_ws(",", "lang", "source")).alias("value"))


@register("a1_read_tsv")
def q_read_tsv(spark, sf_dir):
    t = FI.parse_tsv(labelled_lines(spark, sf_dir))
    return t.select("line_no", F.size("cols").alias("n"), F.get("cols", 0).alias("first"), F.md5(F.get("cols", 1)).alias("h"))


ORACLE["a1_read_tsv"] = f"SELECT doc_id AS line_no, CAST(4 AS INT) AS n, lang AS first, md5({ONE_LINE}) AS h FROM documents"


@register("a2_read_examples")
def q_read_examples(spark, sf_dir):
    e = FI.parse_examples(labelled_lines(spark, sf_dir), "binary", "train")
    return e.select("guid", F.md5("text").alias("h"), Q.joined("labels").alias("labels"))


ORACLE["a2_read_examples"] = f"SELECT 'train-' || doc_id AS guid, md5({ONE_LINE}) AS h, lang AS labels FROM documents"


@register("a3_read_gold_names")
def q_read_gold_names(spark, sf_dir):
    g = FI.parse_gold_names(labelled_lines(spark, sf_dir))
    return g.select("line_no", F.md5("text").alias("h"), Q.joined("names").alias("names"))


ORACLE["a3_read_gold_names"] = f"SELECT doc_id AS line_no, md5({ONE_LINE}) AS h, lang || '|' || source AS names FROM documents"


@register("a4_read_gold_slots")
def q_read_gold_slots(spark, sf_dir):
    """Lines of seven columns from ``customer``; those without a segment have six and are skipped."""
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws("\t", F.lit("0"), "c_name", F.lit("x"), "c_name", F.col("c_nationkey").cast("string"), F.lit("road"),
                       F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return FI.parse_gold_slots(c.select(F.col("c_custkey").alias("line_no"), line.alias("value")))


ORACLE["a4_read_gold_slots"] = """
SELECT c_custkey AS line_no, c_name AS text, c_name AS store, CAST(c_nationkey AS VARCHAR) AS phone, 'road' AS address, c_mktsegment AS time
FROM customer WHERE c_mktsegment <> 'BUILDING'"""


@register("a5_read_bio")
def q_read_bio(spark, sf_dir):
    """F4 sequences written as BIO sentences and parsed again."""
    t = Q.tag_sequences(spark, sf_dir)
    lines = F.zip_with("tokens", "tags", lambda w, g: F.concat(w, F.lit(" "), g))
    b = FI.parse_bio(t.select("doc_id", "chunk_idx", F.array_join(F.concat(F.array(F.lit("-DOCSTART- O")), lines), "\n").alias("value")),
                     ("doc_id", "chunk_idx"))
    return b.select("doc_id", "chunk_idx", F.md5("words").alias("words"), F.size(F.split("labels", " ")).alias("n_labels"))


ORACLE["a5_read_bio"] = f"""
WITH t AS ({_with(CHUNKS_CTE, ALL_SPANS_CTE)} SELECT doc_id, chunk_idx, j, unnest(string_split(tok || ' ' || tag, chr(10))) AS line,
           generate_subscripts(string_split(tok || ' ' || tag, chr(10)), 1) AS i FROM atagged),
w AS (SELECT doc_id, chunk_idx, j, i, string_split(trim(line, ' '), ' ')[1] AS word, string_split(trim(line, ' '), ' ')[-1] AS label
      FROM t WHERE trim(line, ' ') <> '' AND NOT starts_with(line, '-DOCSTART-')),
c AS ({_with(CHUNKS_CTE)} SELECT doc_id, chunk_idx FROM chunks)
SELECT c.doc_id, c.chunk_idx, md5('[CLS]' || coalesce(' ' || string_agg(word, ' ' ORDER BY j, i) FILTER (WHERE word <> ''), '')) AS words,
       CAST(1 + count(label) FILTER (WHERE label <> '') AS INT) AS n_labels
FROM c LEFT JOIN w USING (doc_id, chunk_idx) GROUP BY c.doc_id, c.chunk_idx"""


@register("a8_label_map")
def q_label_map(spark, sf_dir):
    lines = Q.label_map(spark, sf_dir).select(F.concat(F.col("id").cast("string"), F.lit(":'"), "label", F.lit("'")).alias("value"))
    bad = lines.select(F.concat(F.lit("x"), "value").alias("value"))
    return FI.parse_label_map(lines.unionByName(bad))


ORACLE["a8_label_map"] = _with(LABELS_CTE) + " SELECT CAST(id AS INT) AS id, label FROM lmap"


@register("a9_thresholds")
def q_thresholds(spark, sf_dir):
    b = Q.best_thresholds(spark, sf_dir).filter(F.col("cls").isNotNull())
    lines = b.select(F.col("cls").cast("long").alias("line_no"), F.col("threshold").cast("string").alias("value")).unionByName(
        b.select((F.col("cls") - 10).cast("long").alias("line_no"), F.lit("bad").alias("value")))
    classes = b.select(F.explode(F.array(F.col("cls").cast("int"), (F.col("cls") + 4).cast("int"))).alias("class_id")).distinct()
    return FI.parse_thresholds(lines, classes).select("class_id", F.round("threshold", 6).alias("threshold"))


ORACLE["a9_thresholds"] = _with(ML_CTE) + """
SELECT CAST(cls AS INT) AS class_id, round(t, 6) AS threshold FROM best WHERE cls IS NOT NULL
UNION ALL SELECT CAST(cls + 4 AS INT), 0.5 FROM best WHERE cls IS NOT NULL"""


@register("a13_result_log")
def q_result_log(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select(F.timestamp_seconds(F.col("doc_id") * 3600).alias("ts"), F.col("text").alias("article"),
                                                 (F.col("lang") == "en").alias("has_aml"), F.array("lang").alias("names"))
    return FI.result_log_lines(r).select("day", F.md5("value").alias("h"))


ORACLE["a13_result_log"] = """
SELECT strftime(t, '%Y-%m-%d') AS day,
       md5(strftime(t, '%Y-%m-%d %H:%M:%S') || chr(9) || length(text) || chr(9) || text || chr(9) || CASE WHEN lang = 'en' THEN '1' ELSE '0' END
           || chr(9) || '["' || lang || '"]') AS h
FROM (SELECT *, epoch_ms(doc_id * 3600000) AS t FROM documents)"""


@register("a14_prediction_lines")
def q_prediction_lines(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir).select("doc_id", "cls", (F.col("prob") * 100).cast("int").alias("a"),
                                                         (F.col("logit") * 10).cast("int").alias("b"))
    return FI.prediction_lines(s, ["a", "b"], ("doc_id", "cls"))


ORACLE["a14_prediction_lines"] = _with(ML_CTE) + """
SELECT doc_id, CAST(cls AS INT) AS cls, CAST(trunc(prob * 100) AS INT) || chr(9) || CAST(trunc(logit * 10) AS INT) AS value FROM ml"""


@register("a15_compare_report")
def q_compare_report(spark, sf_dir):
    """Gold F4 tags against tags whose inner ones are lost; labels equal on even chunks."""
    t = Q.tag_sequences(spark, sf_dir)
    x = t.select("doc_id", "chunk_idx", "tokens", "tags", F.transform("tags", lambda g: F.replace(g, F.lit("I_NAME"), F.lit("O"))).alias("pred_tags"),
                 F.array(F.lit("a"), F.lit("b")).alias("labels"),
                 F.when(F.col("chunk_idx") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("pred_labels"))
    r = FI.compare_report(x, ("doc_id", "chunk_idx"))
    return r.select("doc_id", "chunk_idx", "frame", "intent", "slot", "labels", "pred_labels", F.md5("tags").alias("tags"), F.md5("pred_tags").alias("pred_tags"))


ORACLE["a15_compare_report"] = f"""
WITH t AS ({_with(CHUNKS_CTE, ALL_SPANS_CTE)} SELECT doc_id, chunk_idx, string_agg(tag, ' ' ORDER BY j) AS tags, bool_or(tag = 'I_NAME') AS lost
           FROM atagged GROUP BY doc_id, chunk_idx),
c AS ({_with(CHUNKS_CTE)} SELECT doc_id, chunk_idx FROM chunks)
SELECT c.doc_id, c.chunk_idx, CASE WHEN NOT coalesce(lost, false) AND c.chunk_idx % 2 = 0 THEN 'O' ELSE 'X' END AS frame,
       CASE WHEN c.chunk_idx % 2 = 0 THEN 'O' ELSE 'X' END AS intent, CASE WHEN coalesce(lost, false) THEN 'X' ELSE 'O' END AS slot,
       'a, b' AS labels, CASE WHEN c.chunk_idx % 2 = 0 THEN 'b, a' ELSE 'a' END AS pred_labels,
       md5('[CLS]' || coalesce(' ' || tags, '')) AS tags, md5('[CLS]' || coalesce(' ' || replace(tags, 'I_NAME', 'O'), '')) AS pred_tags
FROM c LEFT JOIN t USING (doc_id, chunk_idx)"""


@register("a16_metric_lines")
def q_metric_lines(spark, sf_dir):
    return FI.metric_lines(FI.metrics_table(Q.REGISTRY["d9_prf_macro"](spark, sf_dir)))


ORACLE["a16_metric_lines"] = f"""
SELECT unnest(['precision', 'recall', 'fbeta']) AS key,
       unnest(['precision = ' || precision, 'recall = ' || recall, 'fbeta = ' || fbeta]) AS value FROM ({ORACLE['d9_prf_macro']})"""


# ---------------------------------------------------------------- the flagship with scores as columns of rows
@register("k9_screen_by_model")
def q_screen_by_model(spark, sf_dir):
    """K9 in its exploded form, chunk and mention scores added by DataFrame steps (here the fixtures F3 and F6)."""
    def chunk_scores(df):
        s = fixtures.chunk_score(F.col("doc_id"), F.col("chunk_idx"))
        return df.select("*", s["p_pos"].alias("p_pos"), s["p_neg"].alias("p_neg"))

    def mention_scores(df):
        s = fixtures.mention_score(F.col("doc_id"), F.col("chunk_idx"), F.col("start"))
        return df.select("*", s["p_pos"].alias("p_pos"), s["p_neg"].alias("p_neg"))

    out = screening.screen_by_model(fixtures.articles(spark, sf_dir), chunk_scores, mention_scores,
                                    fixtures.keywords(spark, sf_dir), max_len=Q.CHUNK_LEN)
    return out.select("doc_id", "has_aml", "split_cnt", F.size("ner_names").alias("n_ner_names"),
                      Q.joined("ner_names").alias("ner_names"), Q.joined("names").alias("names"))


ORACLE["k9_screen_by_model"] = ORACLE["k9_screen_articles"]


# ---------------------------------------------------------------- legacy spans, splitters, list files
from ..functions import splitting as SP  # noqa: E402
from ..operators.split import split_posts  # noqa: E402


@register("e3_bio_decode_legacy")
def q_bio_decode_legacy(spark, sf_dir):
    """E3 on the F4 tags, and the names it comes to; nearly all chunks with a name of two words differ from E2."""
    t = Q.tag_sequences(spark, sf_dir).select("doc_id", "chunk_idx", S.bio_spans_legacy("tokens", "tags", " ").alias("spans"))
    t = t.select("doc_id", "chunk_idx", Q.joined(S.merge_legacy_names("spans")).alias("names"),
                 F.posexplode_outer("spans").alias("span_idx", "s")).filter(F.col("s").isNotNull())
    return t.select("doc_id", "chunk_idx", "names", "span_idx", "s.slot_type", "s.text", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"))


ORACLE["e3_bio_decode_legacy"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """,
it AS (SELECT doc_id, chunk_idx, j, replace(tok, '#', '') AS w, tag, substr(tag, 3) AS ty,
              row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY j) AS r FROM atagged WHERE tag <> 'O'),
walk AS (
  SELECT doc_id, chunk_idx, r, CASE WHEN tag LIKE 'B%' THEN tag ELSE '' END AS typ, CASE WHEN tag LIKE 'B%' THEN w ELSE '' END AS slot,
         CASE WHEN tag LIKE 'B%' THEN j ELSE -1 END AS b, j AS e, NULL::VARCHAR AS otype, NULL::VARCHAR AS otext, NULL::BIGINT AS ob, NULL::BIGINT AS oe
  FROM it WHERE r = 1
  UNION ALL
  SELECT i.doc_id, i.chunk_idx, i.r,
         CASE WHEN i.tag LIKE 'B%' AND s.slot = '' THEN i.tag WHEN i.tag LIKE 'I%' AND s.typ = '' THEN '' ELSE i.ty END,
         CASE WHEN i.tag LIKE 'B%' AND s.slot = '' THEN i.w WHEN i.tag LIKE 'I%' AND i.ty = s.typ THEN s.slot || i.w
              WHEN i.tag LIKE 'I%' AND s.typ = '' THEN s.slot ELSE i.w END,
         CASE WHEN i.tag LIKE 'B%' THEN i.j ELSE s.b END, i.j,
         CASE WHEN out THEN s.typ END, CASE WHEN out THEN s.slot END, CASE WHEN out THEN CASE WHEN i.tag LIKE 'B%' THEN i.j ELSE s.b END END, CASE WHEN out THEN i.j END
  FROM (SELECT s.*, i.r AS nr, CASE WHEN i.tag LIKE 'B%' THEN s.slot <> '' ELSE s.typ <> '' AND i.ty <> s.typ END AS out
        FROM walk s JOIN it i ON i.doc_id = s.doc_id AND i.chunk_idx = s.chunk_idx AND i.r = s.r + 1) s
  JOIN it i ON i.doc_id = s.doc_id AND i.chunk_idx = s.chunk_idx AND i.r = s.nr),
spans3 AS (
  SELECT doc_id, chunk_idx, r, otype AS slot_type, otext AS text, ob AS b, oe AS e FROM walk WHERE otype IS NOT NULL
  UNION ALL SELECT doc_id, chunk_idx, r + 1, typ, slot, b, e FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY r DESC) AS last FROM walk) WHERE last = 1 AND slot <> ''),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY r) - 1 AS span_idx FROM spans3),
nm AS (SELECT doc_id, chunk_idx, list(text ORDER BY span_idx) FILTER (slot_type = 'NAME') AS l, first(text ORDER BY span_idx) FILTER (slot_type = 'B_NAME') AS f
       FROM num GROUP BY doc_id, chunk_idx)
SELECT n.doc_id, n.chunk_idx, coalesce(CASE WHEN len(l) > 0 THEN array_to_string([coalesce(f, '') || l[1]] || l[2:], '|') END, '') AS names,
       CAST(span_idx AS INT) AS span_idx, slot_type, text, CAST(b AS INT) AS "begin", CAST(e AS INT) AS "end"
FROM num n JOIN nm USING (doc_id, chunk_idx)"""


@register("h15_pair_text")
def q_pair_text(spark, sf_dir):
    return Q.REGISTRY["h14_mention_sentence"](spark, sf_dir).select(
        "doc_id", "chunk_idx", "start", screening.pair_text(F.col("name"), F.col("sentence")).alias("pair_text"))


ORACLE["h15_pair_text"] = f"SELECT doc_id, chunk_idx, start, concat_ws('[SEP]', name, sentence) AS pair_text FROM ({ORACLE['h14_mention_sentence']})"

SPLIT_LEN, POST_LEN, POST_MARKS = 100, 128, (".", "!", " ")


@register("h12_split_on_mark")
def q_split_on_mark(spark, sf_dir):
    """H12 at full stops; sentences over 100 characters move the scan on, and the text before the next cut is lost."""
    d = fixtures.articles(spark, sf_dir).select("doc_id", F.length("text").alias("n"), SP.split_on_mark("text", SPLIT_LEN, ".").alias("l"))
    lost = F.col("n") - F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x))
    return d.select("doc_id", lost.alias("lost"), F.posexplode("l").alias("piece_idx", "piece"))


@register("h13_split_posts")
def q_split_posts(spark, sf_dir):
    """H13 over the documents: full stops, exclamation marks, spaces; the other columns go along."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    return split_posts(d, "content", POST_LEN, POST_MARKS).select("doc_id", "lang", "piece_idx", F.md5("content").alias("h"), F.length("content").alias("n"))


def split_sql(name: str, source: str, max_len: int, mark: str) -> str:
    """CTEs ``{name}(k, i, piece)`` of H12 over ``(k, t)`` of ``source``: a scan index and the start of the open piece, step by step."""
    window = f"substring(t, idx + 1, {max_len})"
    last = f"(CASE WHEN contains({window}, '{mark}') THEN length({window}) - instr(reverse({window}), '{mark}') + 1 ELSE 0 END)"
    return f"""
{name}w AS (
  SELECT k, t, length(t) AS n, 0 AS idx, 0 AS start, 0 AS step, NULL::VARCHAR AS piece FROM {source}
  UNION ALL
  SELECT k, t, n, CASE WHEN p > 1 THEN idx + p - 1 ELSE idx + {max_len} END, CASE WHEN p > 1 THEN idx + p - 1 ELSE start END, step + 1,
         CASE WHEN p > 1 THEN substring(t, idx + 1, p - 1) END
  FROM (SELECT *, {last} AS p FROM {name}w WHERE idx + {max_len} < n)),
{name}l AS (SELECT k, t, n, start, step FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY step DESC) AS rn FROM {name}w) WHERE rn = 1),
{name} AS (SELECT k, step AS i, piece FROM {name}w WHERE piece IS NOT NULL
           UNION ALL SELECT k, step + 1, substring(t, start + 1) FROM {name}l WHERE start < n)"""


ORACLE["h12_split_on_mark"] = _with("d AS (SELECT doc_id AS k, text AS t FROM documents)", split_sql("s", "d", SPLIT_LEN, ".")) + """
SELECT k AS doc_id, CAST(length(text) - sum(length(piece)) OVER (PARTITION BY k) AS INT) AS lost,
       CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INT) AS piece_idx, piece
FROM s JOIN documents ON doc_id = k"""
ORACLE["h13_split_posts"] = _with(
    "d AS (SELECT doc_id AS k, text AS t FROM documents)", split_sql("s1", "d", POST_LEN, "."),
    "d2 AS (SELECT (k, i) AS k, piece AS t FROM s1)", split_sql("s2", "d2", POST_LEN, "!"),
    "d3 AS (SELECT (k, i) AS k, piece AS t FROM s2)", split_sql("s3", "d3", POST_LEN, " ")) + """
SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i1, i2, i) - 1 AS INT) AS piece_idx, md5(piece) AS h, CAST(length(piece) AS INT) AS n
FROM (SELECT k[1][1] AS id, k[1][2] AS i1, k[2] AS i2, i, piece FROM s3) JOIN documents ON doc_id = id"""


@register("a6_json_list")
def q_json_list(spark, sf_dir):
    """The documents as the lines of list files, and read back from them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    back = FI.parse_json_list_lines(FI.json_list_lines(d), d.schema)
    return back.select("doc_id", F.md5("text").alias("h"), "lang", "source")


ORACLE["a6_json_list"] = "SELECT doc_id, md5(text) AS h, lang, source FROM documents"


@register("a10_read_keywords")
def q_read_keywords(spark, sf_dir):
    """A10 over lines: the words of page titles, every seventh line blank."""
    p = table(spark, sf_dir, "pages")
    line = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return FI.parse_keywords(p.select(line.alias("value")))


ORACLE["a10_read_keywords"] = r"""
SELECT keyword FROM (SELECT CASE WHEN page_id % 7 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS keyword FROM pages) WHERE keyword <> ''"""


@register("a17_features")
def q_features(spark, sf_dir):
    """Encoded features written, read back as 32-bit integers."""
    ids = TK.doc_piece_ids(Q.docs(spark, sf_dir), T.basic_tokens("text"), Q.corpus_vocab(spark, sf_dir)[1], Q.CLASSIFIER_LEN - 2)
    cls, sep = (F.lit(TK.SPECIAL_TOKENS.index(x)) for x in ("[CLS]", "[SEP]"))
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    FI.write_features(ids.select("doc_id", TK.encode_ids("ids", cls, sep, Q.CLASSIFIER_LEN).alias("e")).select("doc_id", "e.*"), path)
    f = FI.read_features(spark, path)
    return f.select("doc_id", as_text(F.col("input_ids")).alias("input_ids"),
                    F.aggregate("input_mask", F.lit(0), lambda a, x: a + x).alias("n_real"), F.size("segment_ids").alias("n_segments"))


ORACLE["a17_features"] = ORACLE["j1_encode_single"]
