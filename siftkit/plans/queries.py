"""Registered queries: one per survey operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or data Spark derives from them) whole.
Array results are also given as ``|``-joined strings and doubles are rounded,
so the DuckDB oracle in ``oracle.py`` can compare values.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import LATIN_MARKS, let
from ..operators.order import row_numbers
from ..operators.split import split_chunks
from ..sources import fixtures
from ..session import shared_table
from ..sources.tables import table
from . import screening

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

CHUNK_LEN = 511  # live-path chunk length


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def joined(c) -> F.Column:
    return F.array_join(c, "|")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11 over F1 at the live-path length with Latin marks."""
    return split_chunks(fixtures.articles(spark, sf_dir), max_len=CHUNK_LEN, marks=LATIN_MARKS)


@register("k9_screen_articles")
def q_screen_articles(spark, sf_dir):
    docs = fixtures.articles(spark, sf_dir)
    kws = fixtures.keywords(spark, sf_dir)
    out = screening.screen_articles(docs, kws, max_len=CHUNK_LEN)
    return out.select("doc_id", "has_aml", "split_cnt",
                      F.size("ner_names").alias("n_ner_names"),
                      joined("ner_names").alias("ner_names"), joined("names").alias("names"))


@register("h11_content_split")
def q_content_split(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "chunk_idx", "chunk",
                                        F.length("chunk").alias("chunk_len"))


# ---------------------------------------------------------------- chunk-level fixtures
from ..functions import gate as G  # noqa: E402
from ..functions import names as N  # noqa: E402
from ..functions import spans as S  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..functions.splitting import mention_sentence  # noqa: E402


def tagged_chunks(spark, sf_dir) -> DataFrame:
    """F2 chunks with F4 tags decoded to spans (E2, word tokens joined by a space)."""
    c = chunks(spark, sf_dir).select("doc_id", "chunk_idx", "chunk",
                                     S.capital_tags(F.col("chunk")).alias("tg"))
    return c.select("doc_id", "chunk_idx", "chunk",
                    S.bio_spans("tg.tokens", "tg.tags", " ").alias("spans"))


def chunk_names5(spark, sf_dir) -> DataFrame:
    """F5 in the chunk's row: NAME spans cut to 1-3 words (1 + begin % 3); ``name_u`` has an injected ``[UNK]``."""
    def cut(span, i):
        b = span["begin"]

        def both(name):
            unk = F.when((b % 5 == 0) & (F.length(name) >= 3),
                         F.concat(F.substring(name, 1, 1), F.lit("[UNK]"), name.substr(F.lit(3), F.length(name)))).otherwise(name)
            return F.struct(i.alias("span_idx"), b.alias("b"), name.alias("name"), unk.alias("name_u"))

        return let(F.array_join(F.slice(F.split(span["text"], " "), F.lit(1), b % 3 + 1), " "), both)

    return tagged_chunks(spark, sf_dir).select("doc_id", "chunk_idx", "chunk", F.transform(
        F.filter("spans", lambda x: x["slot_type"] == "NAME"), cut).alias("names"))


def exploded(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """One row an element in ``x``.

    The outer form with a null test, because Spark derives a filter from the inner form that
    evaluates the whole array expression once more.
    """
    return df.select(*keep, F.explode_outer(array).alias("x")).filter(F.col("x").isNotNull())


def names5(spark, sf_dir) -> DataFrame:
    return exploded(chunk_names5(spark, sf_dir), "names", "doc_id", "chunk_idx", "chunk").select(
        "doc_id", "chunk_idx", "chunk", "x.span_idx", "x.b", "x.name", "x.name_u")


def scored_chunks(spark, sf_dir) -> DataFrame:
    """F2 with F3 scores and the keyword-rule gate (K7)."""
    c = chunks(spark, sf_dir)
    kw = fixtures.keywords(spark, sf_dir).select(F.collect_list("keyword")).scalar()
    sc = fixtures.chunk_score(F.col("doc_id"), F.col("chunk_idx"))
    return c.select("doc_id", "chunk_idx", "chunk", sc["p_pos"].alias("p_pos"), sc["p_neg"].alias("p_neg"),
                    kw.alias("keywords"))


def mentioned_names():
    """Distinct F5 names of two characters or more, in order of their first span."""
    return F.array_distinct(F.transform(F.filter("names", lambda x: F.length(x["name"]) >= 2), lambda x: x["name"]))


def mention_rows(spark, sf_dir) -> DataFrame:
    """C4 over distinct F5 names of each chunk (two characters or more); no shuffle."""
    n = chunk_names5(spark, sf_dir).select("doc_id", "chunk_idx", "chunk", mentioned_names().alias("names"))
    n = exploded(n, "names", "doc_id", "chunk_idx", "chunk").select("doc_id", "chunk_idx", "chunk", F.col("x").alias("name"))
    m = n.withColumn("m", N.mention_spans("chunk", "name"))
    return exploded(m, "m", "doc_id", "chunk_idx", "chunk", "name").select(
        "doc_id", "chunk_idx", "chunk", "name", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


@register("e2_bio_decode")
def q_bio_decode(spark, sf_dir):
    t = tagged_chunks(spark, sf_dir)
    return t.select("doc_id", "chunk_idx", F.posexplode_outer("spans").alias("span_idx", "s")).filter(
        F.col("s").isNotNull()).select("doc_id", "chunk_idx", "span_idx", "s.slot_type", "s.text", "s.begin", "s.end")


@register("d4_distinct_spans")
def q_distinct_spans(spark, sf_dir):
    t = tagged_chunks(spark, sf_dir).select("doc_id", "chunk_idx", S.distinct_texts("spans", "NAME").alias("d"))
    return t.select("doc_id", "chunk_idx", F.size("d").alias("n_names"), joined("d").alias("names"))


@register("b1_name_filter")
def q_name_filter(spark, sf_dir):
    return names5(spark, sf_dir).select("doc_id", "chunk_idx", "span_idx", "name_u",
                                        N.name_ok("name_u").alias("keep"))


@register("b2_has_unk")
def q_has_unk(spark, sf_dir):
    c = chunk_names5(spark, sf_dir).filter(F.size("names") > 0)
    return c.select("doc_id", "chunk_idx", N.has_unk(F.transform("names", lambda x: x["name_u"])).alias("has_unk"),
                    F.size("names").cast("long").alias("n_names"))


@register("h25_fill_unk")
def q_fill_unk(spark, sf_dir):
    n = names5(spark, sf_dir).filter(F.col("name_u").contains("[UNK]"))
    return n.select("doc_id", "chunk_idx", "span_idx", "name", "name_u",
                    S.fill_unk("chunk", "name_u").alias("recovered"))


# Latin stand-ins for the gender words of the reference's Chinese names.
LATIN_GENDER_WORDS = ("é", "è")


@register("b12_gender_rule")
def q_gender_rule(spark, sf_dir):
    return names5(spark, sf_dir).select("doc_id", "chunk_idx", "span_idx", "name",
                                        (~N.gendered("name", LATIN_GENDER_WORDS)).alias("keep"))


def doc_names(spark, sf_dir) -> DataFrame:
    """All F5 names of a document in order, as one array (bounded by the document); empty where it has none."""
    n = chunk_names5(spark, sf_dir).select("doc_id", "chunk_idx", F.transform("names", lambda x: x["name"]).alias("names"))
    g = n.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "names"))).alias("l")) \
        .select("doc_id", F.flatten(F.transform("l", lambda x: x["names"])).alias("names"))
    every = table(spark, sf_dir, "documents").select("doc_id")
    return every.join(g, "doc_id", "left").select(
        "doc_id", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


@register("c5_subsumed_names")
def q_subsumed(spark, sf_dir):
    d = doc_names(spark, sf_dir)
    return d.select("doc_id", F.explode(F.array_distinct(F.filter("names", lambda x: N.subsumed(x, F.col("names")))))
                    .alias("name"))


@register("d3_unique_names")
def q_unique_names(spark, sf_dir):
    d = doc_names(spark, sf_dir).select("doc_id", N.unique_names("names", LATIN_GENDER_WORDS).alias("u"))
    return d.select("doc_id", F.size("u").alias("n_names"), joined("u").alias("names"))


@register("c4_name_mentions")
def q_mentions(spark, sf_dir):
    return mention_rows(spark, sf_dir).select("doc_id", "chunk_idx", "name", "start", "end")


@register("h14_mention_sentence")
def q_mention_sentence(spark, sf_dir):
    m = mention_rows(spark, sf_dir)
    sent = mention_sentence(F.col("chunk"), F.col("start"), F.col("end"), LATIN_MARKS)
    return m.select("doc_id", "chunk_idx", "name", "start", sent.alias("sentence")).select(
        "*", screening.pair_text(F.col("name"), F.col("sentence")).alias("pair_text"))


def mention_score_sums(spark, sf_dir) -> DataFrame:
    m = mention_rows(spark, sf_dir)
    sc = fixtures.mention_score(F.col("doc_id"), F.col("chunk_idx"), F.col("start"))
    return m.groupBy("doc_id", "chunk_idx", "name").agg(
        F.sum(sc["p_pos"]).alias("sp"), F.sum(sc["p_neg"]).alias("sn"),
        F.max(sc["p_pos"]).alias("mp"), F.max(sc["p_neg"]).alias("mn"), F.count("*").alias("n_mentions"))


@register("d5_name_score_sum")
def q_score_sum(spark, sf_dir):
    s = mention_score_sums(spark, sf_dir)
    return s.select("doc_id", "chunk_idx", "name", "n_mentions", F.round("sp", 6).alias("sum_pos"),
                    F.round("sn", 6).alias("sum_neg"), G.sum_rule("sp", "sn", 0.25).alias("passed"))


@register("d6_name_score_max")
def q_score_max(spark, sf_dir):
    s = mention_score_sums(spark, sf_dir)
    return s.select("doc_id", "chunk_idx", "name", F.round("mp", 6).alias("max_pos"),
                    F.round("mn", 6).alias("max_neg"), G.max_rule("mp", "mn").alias("passed"))


@register("k6_name_check")
def q_name_check(spark, sf_dir):
    names = F.array_distinct(F.transform("names", lambda x: x["name"]))
    # null without names, and filtered afterwards: a filter on the names would make them once more
    checked = let(names, lambda ns: F.when(F.size(ns) > 0, F.array(F.filter(ns, lambda nm: screening.name_check(
        F.col("doc_id"), F.col("chunk_idx"), F.col("chunk"), nm, marks=LATIN_MARKS)))))
    n = exploded(chunk_names5(spark, sf_dir).select("doc_id", "chunk_idx", checked.alias("checked")), "checked", "doc_id", "chunk_idx")
    return n.select("doc_id", "chunk_idx", joined("x").alias("checked_names"))


@register("b3_rule_check")
def q_rule_check(spark, sf_dir):
    c = scored_chunks(spark, sf_dir)
    return c.select("doc_id", "chunk_idx", F.round("p_pos", 6).alias("p_pos"),
                    F.round("p_neg", 6).alias("p_neg"), G.rule_check("p_pos", "p_neg", None, 0.3).alias("label"))


@register("b4_keyword_hit")
def q_keyword_hit(spark, sf_dir):
    c = scored_chunks(spark, sf_dir)
    return c.select("doc_id", "chunk_idx", G.keyword_hit("chunk", "keywords", "equals").alias("hit_equals"),
                    G.keyword_hit("chunk", "keywords", "contains").alias("hit_contains"))


@register("k7_classify_chunks")
def q_classify_chunks(spark, sf_dir):
    c = scored_chunks(spark, sf_dir)
    hit = G.keyword_hit("chunk", "keywords", "equals")
    return c.select("doc_id", "chunk_idx", G.rule_check("p_pos", "p_neg", hit, 0.3).alias("label"))


@register("k7_classify_chunks_contains")
def q_classify_chunks_contains(spark, sf_dir):
    c = scored_chunks(spark, sf_dir)
    hit = G.keyword_hit("chunk", "keywords", "contains")
    return c.select("doc_id", "chunk_idx", G.rule_check("p_pos", "p_neg", hit, 0.3).alias("label"))


def gated(spark, sf_dir) -> DataFrame:
    c = scored_chunks(spark, sf_dir)
    flag = G.rule_check("p_pos", "p_neg", G.keyword_hit("chunk", "keywords", "equals"), 0.3) == 1
    return c.select("doc_id", "chunk_idx", "chunk", flag.alias("has_aml"))


@register("b5_gate")
def q_gate(spark, sf_dir):
    g = gated(spark, sf_dir)
    names = F.when(F.col("has_aml"), screening.chunk_names(F.col("doc_id"), F.col("chunk_idx"), F.col("chunk"))) \
        .otherwise(F.array().cast("array<string>"))
    return g.select("doc_id", "chunk_idx", "has_aml", joined(names).alias("ner_names"))


@register("k8_extract_names")
def q_extract_names(spark, sf_dir):
    g = gated(spark, sf_dir).filter("has_aml")
    names = screening.chunk_names(F.col("doc_id"), F.col("chunk_idx"), F.col("chunk"))
    return g.select("doc_id", "chunk_idx", F.size(names).alias("n_names"), joined(names).alias("ner_names"))


@register("d1_merge_chunks")
def q_merge_chunks(spark, sf_dir):
    g = gated(spark, sf_dir)
    names = F.when(F.col("has_aml"), screening.chunk_names(F.col("doc_id"), F.col("chunk_idx"), F.col("chunk"))) \
        .otherwise(F.array().cast("array<string>"))
    per = g.select("doc_id", "chunk_idx", "has_aml", names.alias("ner_names"))
    m = per.groupBy("doc_id").agg(
        F.bool_or("has_aml").alias("has_aml"), F.count("*").alias("split_cnt"),
        F.sort_array(F.collect_list(F.struct("chunk_idx", "ner_names"))).alias("rs"))
    every = table(spark, sf_dir, "documents").select("doc_id")
    return every.join(m, "doc_id", "left").select(
        "doc_id", F.coalesce("has_aml", F.lit(False)).alias("has_aml"),
        F.coalesce("split_cnt", F.lit(0)).cast("long").alias("split_cnt"),
        F.coalesce(joined(F.flatten(F.transform("rs", lambda r: r["ner_names"]))), F.lit("")).alias("all_ner_names"))


@register("d2_fallback_names")
def q_fallback(spark, sf_dir):
    docs = fixtures.articles(spark, sf_dir)
    out = screening.screen_articles(docs, fixtures.keywords(spark, sf_dir), max_len=CHUNK_LEN)
    return out.select("doc_id", joined("names").alias("names"))


# ---------------------------------------------------------------- string functions
def docs(spark, sf_dir) -> DataFrame:
    return fixtures.articles(spark, sf_dir)


@register("h1_clean_text")
def q_clean_text(spark, sf_dir):
    c = T.clean_text("text")
    return docs(spark, sf_dir).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h2_space_cjk")
def q_space_cjk(spark, sf_dir):
    c = T.space_cjk("text")
    return docs(spark, sf_dir).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h3_strip_accents")
def q_strip_accents(spark, sf_dir):
    c = T.strip_accents(F.lower("text"))
    return docs(spark, sf_dir).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h4_split_punct")
def q_split_punct(spark, sf_dir):
    c = T.split_punct("text")
    return docs(spark, sf_dir).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h5_basic_tokens")
def q_basic_tokens(spark, sf_dir):
    c = T.basic_tokens("text", lower=False)
    return docs(spark, sf_dir).select("doc_id", F.size(c).alias("n_tokens"), F.md5(F.array_join(c, " ")).alias("h"))


@register("h8_remove_symbols")
def q_remove_symbols(spark, sf_dir):
    c = T.remove_symbols("text")
    return docs(spark, sf_dir).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h9_remove_whitespace")
def q_remove_whitespace(spark, sf_dir):
    c = T.remove_whitespace("text")
    return docs(spark, sf_dir).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h17_strip_ip_url")
def q_strip_ip_url(spark, sf_dir):
    c = T.strip_url(T.strip_ip("text"))
    return docs(spark, sf_dir).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h18_label_clean")
def q_label_clean(spark, sf_dir):
    c = T.label_clean("text")
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", F.length(c).alias("n"), F.md5(c).alias("h"))


@register("h24_extract_post_fields")
def q_post_fields(spark, sf_dir):
    p = fixtures.posts(spark, sf_dir)
    f = T.post_fields("content")
    return p.select("post_id", f["name"].alias("name"), f["phone"].alias("phone"),
                    f["address"].alias("address"), f["visit_date"].alias("visit_date"))


@register("h19_post_date")
def q_post_date(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select("post_id", T.post_date("content").alias("post_date"))


@register("h20_place_name")
def q_place_name(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select("post_id", T.place_name("content").alias("name"))


@register("h21_address")
def q_address(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select("post_id", T.address("content").alias("address"))


@register("h22_phone")
def q_phone(spark, sf_dir):
    t = T.strip_url(T.strip_ip("content"))
    return fixtures.posts(spark, sf_dir).select("post_id", T.phone(t).alias("phone"))


@register("h23_visit_date")
def q_visit_date(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select("post_id", T.visit_date("content").alias("visit_date"))


@register("b9_null_words")
def q_null_words(spark, sf_dir):
    p = fixtures.posts(spark, sf_dir)
    raw = F.regexp_extract("content", "電話：([^\n]*)", 1)
    return p.select("post_id", raw.alias("raw"), T.null_words(raw).alias("phone"))


@register("h26_request_digest")
def q_digest(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.request_digest("text", "salt").alias("digest"))


# ---------------------------------------------------------------- metrics
from ..operators import metrics as M  # noqa: E402

POS_CLASSES = (0, 2, 3, 4, 5, 6, 7)


def r6(c):
    return F.round(c, 6)


def _prf_out(df):
    return df.select(*[r6(F.col(c)).alias(c) for c in df.columns])


@register("d7_confusion_matrix")
def q_confusion(spark, sf_dir):
    return M.confusion_matrix(fixtures.class_pairs(spark, sf_dir), "gold", "pred", "w") \
        .select("gold", "pred", r6(F.col("n")).alias("n"))


@register("d8_prf_micro")
def q_prf_micro(spark, sf_dir):
    cm = M.confusion_matrix(fixtures.class_pairs(spark, sf_dir), "gold", "pred", "w")
    return _prf_out(M.prf(cm, POS_CLASSES, 1.0, "micro"))


@register("d9_prf_macro")
def q_prf_macro(spark, sf_dir):
    cm = M.confusion_matrix(fixtures.class_pairs(spark, sf_dir), "gold", "pred", "w")
    return _prf_out(M.prf(cm, POS_CLASSES, 2.0, "macro"))


@register("d10_prf_weighted")
def q_prf_weighted(spark, sf_dir):
    cm = M.confusion_matrix(fixtures.class_pairs(spark, sf_dir), "gold", "pred", "w")
    return _prf_out(M.prf(cm, POS_CLASSES, 0.5, "weighted"))


@register("d11_prf_present")
def q_prf_present(spark, sf_dir):
    return _prf_out(M.prf_present(fixtures.class_pairs(spark, sf_dir), "gold", "pred"))


@register("d12_accuracy")
def q_accuracy(spark, sf_dir):
    return _prf_out(M.accuracy(fixtures.class_pairs(spark, sf_dir), "gold", "pred", "w"))


def sigmoid_ce(x, z):
    """``max(x,0) - x*z + log1p(exp(-|x|))``."""
    return F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))


@register("d13_mean_loss")
def q_mean_loss(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir).withColumn(
        "loss", sigmoid_ce(F.col("logit"), F.col("gold").cast("double")))
    return _prf_out(M.mean_loss(s, "loss"))


def best_thresholds(spark, sf_dir):
    return M.best_f1_threshold(fixtures.multilabel_scores(spark, sf_dir), "cls", "gold", "prob")


@register("d14_best_f1_threshold")
def q_best_f1(spark, sf_dir):
    b = best_thresholds(spark, sf_dir)
    return b.select("cls", *[r6(F.col(c)).alias(c) for c in ("best_f1", "precision", "recall", "threshold")])


@register("d15_prf_per_class")
def q_prf_per_class(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir)
    t = best_thresholds(spark, sf_dir).filter(F.col("cls").isNotNull()).select("cls", "threshold")
    pred = s.join(t, "cls").withColumn("pred", (F.col("prob") > F.col("threshold")).cast("int"))
    out = M.binary_prf(pred, "gold", "pred", group="cls")
    return out.select("cls", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register("d16_auc_per_class")
def q_auc(spark, sf_dir):
    a = M.auc_per_class(fixtures.multilabel_scores(spark, sf_dir), "cls", "gold", "prob")
    return a.select("cls", r6(F.col("auc")).alias("auc"))


def parsed_labels(spark, sf_dir):
    """J6 over F14."""
    ll = fixtures.label_lists(spark, sf_dir)
    return ll.select("doc_id", F.split(F.expr("trim(BOTH '[]' FROM label_list)"), ", ").alias("labels"))


@register("d17_class_weights")
def q_class_weights(spark, sf_dir):
    lab = parsed_labels(spark, sf_dir).select(F.explode("labels").alias("label"))
    return M.class_weights(lab, "label", extra=("[CLS]",)).select("label", r6(F.col("weight")).alias("weight"))


@register("i2_softmax")
def q_softmax(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir)
    v = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cls", "logit"))).alias("l")) \
        .select("doc_id", F.transform("l", lambda x: x["logit"]).alias("x"))
    mx = F.array_max("x")
    lse = F.log(F.aggregate("x", F.lit(0.0), lambda a, e: a + F.exp(e - mx))) + mx
    out = v.select("doc_id", F.posexplode(F.transform("x", lambda e: F.struct(
        F.exp(e - lse).alias("softmax"), (e - lse).alias("log_softmax")))).alias("cls", "r"))
    return out.select("doc_id", "cls", r6(F.col("r.softmax")).alias("softmax"),
                      r6(F.col("r.log_softmax")).alias("log_softmax"))


@register("i3_cross_entropy")
def q_cross_entropy(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("y"))
    v = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cls", "logit"))).alias("l")) \
        .select("doc_id", F.transform("l", lambda x: x["logit"]).alias("x")).join(lab, "doc_id")
    mx = F.array_max("x")
    lse = F.log(F.aggregate("x", F.lit(0.0), lambda a, e: a + F.exp(e - mx))) + mx
    ce = -(F.get("x", F.col("y")) - lse)
    return v.select("doc_id", r6(ce).alias("cross_entropy"))


@register("i4_sigmoid_squared_error")
def q_sigmoid(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir)
    sig = 1.0 / (1.0 + F.exp(-F.col("logit")))
    return s.select("doc_id", "cls", r6(sig).alias("sigmoid"), r6(F.pow(sig - F.col("gold"), 2)).alias("sq_err"))


@register("i5_sigmoid_cross_entropy")
def q_sigmoid_ce(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir)
    return s.select("doc_id", "cls", r6(sigmoid_ce(F.col("logit"), F.col("gold").cast("double"))).alias("loss"))


@register("i6_weighted_cross_entropy")
def q_weighted_ce(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir)
    pos = s.groupBy("cls").agg(M.safe_div(F.count("*"), 2.0 * F.sum("gold")).alias("q"))
    x, z, q = F.col("logit"), F.col("gold").cast("double"), F.col("q")
    loss = (1 - z) * x + (1 + (q - 1) * z) * (F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))
    return s.join(F.broadcast(pos), "cls").groupBy("doc_id").agg(r6(F.sum(loss)).alias("loss"))


@register("i7_safe_div")
def q_safe_div(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(M.safe_div(F.col("l_discount"), F.col("l_tax"))).alias("ratio"))


@register("i1_stamp")
def q_stamp(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.select("event_id", F.unix_millis("ts").alias("epoch_ms"), F.unix_seconds("ts").alias("epoch_s"),
                     F.date_format("ts", "yyyy-MM-dd").alias("day"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@register("f1_argmax_class")
def q_argmax(spark, sf_dir):
    s = fixtures.multilabel_scores(spark, sf_dir)
    v = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cls", "logit"))).alias("l")) \
        .select("doc_id", F.transform("l", lambda x: x["logit"]).alias("x"))
    return v.select("doc_id", (F.array_position("x", F.array_max("x")) - 1).cast("int").alias("argmax"))


def threshold_labels(spark, sf_dir, strict: bool):
    s = fixtures.multilabel_scores(spark, sf_dir)
    t = best_thresholds(spark, sf_dir).filter(F.col("cls").isNotNull()).select("cls", "threshold")
    kept = M.over_threshold(F.col("prob"), F.col("threshold"), strict)
    g = s.join(t, "cls").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(kept, F.struct("cls", "prob")))).alias("l"))
    return g.select("doc_id", F.array_join(F.transform("l", lambda x: F.concat(
        x["cls"].cast("string"), F.lit(":"), x["prob"].cast("string"))), "|").alias("labels"))


@register("b6_threshold_labels")
def q_threshold_labels(spark, sf_dir):
    return threshold_labels(spark, sf_dir, strict=False)


@register("b6_labels_over_threshold")
def q_labels_over_threshold(spark, sf_dir):
    """B6 with the predict report's boundary (``>``)."""
    return threshold_labels(spark, sf_dir, strict=True)


@register("b10_drop_padding")
def q_drop_padding(spark, sf_dir):
    p = fixtures.class_pairs(spark, sf_dir).filter(F.col("w") > 0)
    return p.groupBy("gold").agg(F.count("*").alias("n_real"))


@register("d20_compare_rates")
def q_compare_rates(spark, sf_dir):
    p = fixtures.class_pairs(spark, sf_dir)
    per = p.groupBy("l_orderkey").agg((F.max("gold") == F.max("pred")).alias("intent_ok"),
                                      F.bool_and(F.col("gold") == F.col("pred")).alias("slot_ok"))
    rate = lambda c: r6(F.avg(F.col(c).cast("double")))
    return per.withColumn("frame_ok", F.col("intent_ok") & F.col("slot_ok")).agg(
        rate("intent_ok").alias("intent_rate"), rate("slot_ok").alias("slot_rate"), rate("frame_ok").alias("frame_rate"))


@register("g3_complement_classes")
def q_complement(spark, sf_dir):
    g = fixtures.class_pairs(spark, sf_dir).select(F.col("gold").alias("cls")).distinct()
    pos = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in POS_CLASSES])).alias("cls"))
    return g.join(pos, "cls", "left_anti")


@register("g4_union_results")
def q_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    en = split_chunks(d.filter(english), max_len=CHUNK_LEN, marks=LATIN_MARKS)
    other = split_chunks(d.filter(~english), max_len=CHUNK_LEN, marks=LATIN_MARKS)
    u = en.unionByName(other)
    return u.groupBy("doc_id").agg(F.count("*").alias("split_cnt"), F.sum(F.length("chunk")).alias("n_chars"))


@register("j6_parse_label_list")
def q_parse_labels(spark, sf_dir):
    p = parsed_labels(spark, sf_dir)
    return p.select("doc_id", F.size("labels").alias("n"), joined("labels").alias("labels"))


def label_map(spark, sf_dir):
    """E4 over the parsed labels: sorted distinct labels -> 0..n-1."""
    from pyspark.sql import Window
    lab = parsed_labels(spark, sf_dir).select(F.explode("labels").alias("label")).distinct()
    return lab.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("id"))


@register("e4_dense_label_ids")
def q_dense_ids(spark, sf_dir):
    return label_map(spark, sf_dir)


@register("g2_label_vocab")
def q_label_vocab(spark, sf_dir):
    lab = parsed_labels(spark, sf_dir).select(F.explode("labels").alias("label"))
    tags = tagged_chunks(spark, sf_dir).select(F.explode(F.transform("spans", lambda s: s["slot_type"])).alias("label"))
    return lab.unionByName(tags).unionByName(spark.range(1).select(F.lit("[CLS]").alias("label"))).distinct()


@register("j7_multi_hot")
def q_multi_hot(spark, sf_dir):
    all_labels = label_map(spark, sf_dir).select(F.sort_array(F.collect_list(F.struct("id", "label")))).scalar()
    p = parsed_labels(spark, sf_dir).withColumn("all", all_labels)
    hot = F.transform("all", lambda x: F.array_contains("labels", x["label"]).cast("int").cast("string"))
    return p.select("doc_id", F.array_join(hot, "").alias("multi_hot"))


@register("j8_one_hot")
def q_one_hot(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("y"))
    oh = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == F.col("y")).cast("int").cast("string"))
    return lab.select("doc_id", F.array_join(oh, "").alias("one_hot"))


# ---------------------------------------------------------------- tokens and encoders
from ..operators import tokens as TK  # noqa: E402
from ..operators import wordpiece as WP  # noqa: E402

CLASSIFIER_LEN = 511   # news classifier sequence length
NAME_PAIR_LEN = 50     # name classifier sequence length


#: So many commonest words and characters.
VOCAB_WORDS = 2000


def vocab(spark, sf_dir, counts: DataFrame | None = None) -> DataFrame:
    """F10 over the documents, words = H5 tokens (cased)."""
    return TK.build_vocab(docs(spark, sf_dir), T.basic_tokens("text"), VOCAB_WORDS, counts=counts)


def shared_vocab(spark, sf_dir) -> DataFrame:
    """The vocabulary, built once and written to the shared folder."""
    return shared_table(vocab(spark, sf_dir), "vocab")


@register("a7_read_vocab")
def q_read_vocab(spark, sf_dir):
    """A7 over lines: the words of ``documents.lang`` and ``source``, padded, some of them twice."""
    d = table(spark, sf_dir, "documents")
    line = F.concat(F.lit(" \t"), "source", F.lit("-"), "lang", F.lit("-"), (F.col("doc_id") % 50).cast("string"), F.lit("  "))
    return TK.parse_vocab(d.select(F.col("doc_id").alias("line_no"), line.alias("value")))


@register("h6_wordpiece")
def q_wordpiece(spark, sf_dir):
    counts = TK.token_counts(docs(spark, sf_dir), T.basic_tokens("text"))
    wp = WP.wordpiece(counts, shared_table(vocab(spark, sf_dir, counts), "vocab"), token="w")
    return wp.select("token", F.array_join("pieces", " ").alias("pieces"),
                     F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def corpus_vocab(spark, sf_dir):
    """The vocabulary as a table and as the trie's tasks read it."""
    v = shared_vocab(spark, sf_dir)
    return v, WP.share_vocab(v)


@register("h7_tokenize_corpus")
def q_tokenize_corpus(spark, sf_dir):
    v, shared = corpus_vocab(spark, sf_dir)
    return TK.piece_counts(docs(spark, sf_dir), T.basic_tokens("text"), shared, v)


@register("h7_piece_rows")
def q_piece_rows(spark, sf_dir):
    v, shared = corpus_vocab(spark, sf_dir)
    return TK.tokenize_corpus(docs(spark, sf_dir), T.basic_tokens("text"), shared, v)


@register("j1_encode_single")
def q_encode_single(spark, sf_dir):
    d = docs(spark, sf_dir)
    # F10 puts the special tokens first, so their ids are their positions
    cls_id = F.lit(TK.SPECIAL_TOKENS.index("[CLS]"))
    sep_id = F.lit(TK.SPECIAL_TOKENS.index("[SEP]"))
    ids = TK.doc_piece_ids(d, T.basic_tokens("text"), corpus_vocab(spark, sf_dir)[1], CLASSIFIER_LEN - 2)
    enc = TK.encode_ids(F.col("ids"), cls_id, sep_id, CLASSIFIER_LEN)
    as_text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return ids.select("doc_id", as_text(enc["input_ids"]).alias("input_ids"),
                      F.aggregate(enc["input_mask"], F.lit(0), lambda a, x: a + x).alias("n_real"),
                      F.size(enc["segment_ids"]).alias("n_segments"))


@register("c2_ids_to_tokens")
def q_ids_to_tokens(spark, sf_dir):
    v, shared = corpus_vocab(spark, sf_dir)
    ids = TK.doc_piece_ids(docs(spark, sf_dir), T.basic_tokens("text"), shared)
    got = TK.ids_to_tokens(ids, v)
    return got.select("doc_id", F.size("tokens").alias("n_pieces"), F.md5(F.array_join("tokens", " ")).alias("h"))


def turn_pairs(spark, sf_dir) -> DataFrame:
    """two consecutive turns of one conversation."""
    from pyspark.sql import Window
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")) \
        .filter(F.col("b").isNotNull())


@register("j3_truncate_pair")
def q_truncate_pair(spark, sf_dir):
    p = turn_pairs(spark, sf_dir).select("conv_id", "turn", T.basic_tokens("a").alias("ta"),
                                        T.basic_tokens("b").alias("tb"))
    t = TK.truncate_pair("ta", "tb", NAME_PAIR_LEN - 3)
    return p.select("conv_id", "turn", F.size(t["a"]).alias("len_a"), F.size(t["b"]).alias("len_b"),
                    screening.pair_text(F.array_join(t["a"], " "), F.array_join(t["b"], " ")).alias("pair"))


@register("e5_transition_counts")
def q_transitions(spark, sf_dir):
    c = chunks(spark, sf_dir).select(S.capital_tags(F.col("chunk")).alias("tg"))
    return exploded(c.select(MD.tag_bigrams("tg.tags").alias("p")), "p").groupBy("x.prev_tag", "x.tag").agg(F.count("*").alias("n"))


@register("e1_row_guid")
def q_row_guid(spark, sf_dir):
    d = row_numbers(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.select("doc_id", F.concat(F.lit("train-"), F.col("row").cast("string")).alias("guid"))


@register("f2_preview")
def q_preview(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.orderBy("doc_id").limit(5).select("doc_id", F.size(T.basic_tokens("text")).alias("n_tokens"))


@register("f3_truncate_seq")
def q_truncate_seq(spark, sf_dir):
    d = docs(spark, sf_dir)
    t = F.slice(T.basic_tokens("text"), 1, CLASSIFIER_LEN - 2)
    return d.select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("h"))


@register("b11_skip_null_token")
def q_skip_null(spark, sf_dir):
    c = chunks(spark, sf_dir)
    toks = F.split(F.regexp_replace("chunk", "[.,!?]", " **NULL** "), " +")
    kept = F.filter(toks, lambda t: t != "**NULL**")
    return c.select("doc_id", "chunk_idx", F.size(toks).alias("n_all"), F.size(kept).alias("n_kept"))


@register("c7_zip_tags")
def q_zip_tags(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", "chunk_idx", "chunk", S.capital_tags(F.col("chunk")).alias("tg"))
    chars = F.regexp_extract_all(F.col("chunk"), F.lit("(?s)."), 0)
    n = F.least(F.size(chars), F.size("tg.tags"))
    z = F.zip_with(F.slice(chars, F.lit(1), n), F.slice("tg.tags", F.lit(1), n), lambda c, t: F.concat_ws(" ", c, t))
    return c.select("doc_id", "chunk_idx", F.size(z).alias("n_pairs"), F.md5(F.array_join(z, "|")).alias("h"))


@register("j9_masked_slice")
def q_masked_slice(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", "chunk_idx", S.capital_tags(F.col("chunk")).alias("tg"))
    n = F.size("tg.tags")
    padded = F.concat("tg.tags", F.array_repeat(F.lit("[PAD]"), F.greatest(F.lit(512) - n, F.lit(0))))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(512) - n, F.lit(0))))
    cut = F.slice(padded, 1, F.aggregate(mask, F.lit(0), lambda a, x: a + x))
    return c.select("doc_id", "chunk_idx", F.size(cut).alias("n"), F.array_join(cut, " ").alias("tags"))


# ---------------------------------------------------------------- requests, pages
from ..functions import requests as RQ  # noqa: E402
from ..sources import pages as PG  # noqa: E402

SALT = "siftkit"


def parsed_requests(spark, sf_dir):
    r = fixtures.requests(spark, sf_dir)
    return r.select("doc_id", RQ.parse_request("body").alias("req"))


@register("j12_parse_request")
def q_parse_request(spark, sf_dir):
    p = parsed_requests(spark, sf_dir)
    return p.select("doc_id", F.col("req.ts").alias("ts"), F.col("req.id").alias("id"),
                    F.length("req.news").alias("news_len"))


@register("l3_error_rows")
def q_error_rows(spark, sf_dir):
    p = parsed_requests(spark, sf_dir)
    return p.select("doc_id", RQ.request_status("req").alias("status"))


@register("d21_request_counters")
def q_request_counters(spark, sf_dir):
    p = parsed_requests(spark, sf_dir)
    return p.groupBy(RQ.request_status("req").alias("status")).agg(F.count("*").alias("n"))


@register("j14_build_reply")
def q_build_reply(spark, sf_dir):
    p = parsed_requests(spark, sf_dir).filter(RQ.request_status("req") == "ok")
    news = p.select("doc_id", F.col("req.news").alias("text"))
    names = screening.screen_articles(news, fixtures.keywords(spark, sf_dir), max_len=CHUNK_LEN).select("doc_id", "names")
    reply = RQ.build_reply("req", "names", SALT, F.col("req.ts") + 1)
    r = p.join(names, "doc_id").select("doc_id", reply.alias("r"))
    return r.select("doc_id", "r.req_id", joined("r.answer").alias("answer"), F.col("r.server_digest").alias("digest"), "r.server_ts")


@register("a11_extract_links")
def q_extract_links(spark, sf_dir):
    return PG.extract_links(table(spark, sf_dir, "pages"))


@register("a12_extract_article")
def q_extract_article(spark, sf_dir):
    a = PG.extract_article(table(spark, sf_dir, "pages"))
    return a.select("page_id", "url", "published_time", "title", F.size("content").alias("n_texts"),
                    F.md5(joined("content")).alias("content_md5"), "category", joined("keywords").alias("keywords"), "item_type")


# ---------------------------------------------------------------- tagger
from . import models as MD  # noqa: E402


def tag_sequences(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir).select("doc_id", "chunk_idx", S.capital_tags(F.col("chunk")).alias("tg"))
    return c.select("doc_id", "chunk_idx", F.col("tg.tokens").alias("tokens"), F.col("tg.tags").alias("tags"))


def tag_blocks(spark, sf_dir) -> DataFrame:
    """``tag_sequences`` in blocks of tokens (about six characters each); the chunks are dealt before they are tagged, written once."""
    n = fixtures.articles(spark, sf_dir).agg(F.sum(F.length("text"))).first()[0] or 0
    c = MD.dealt_in_blocks(chunks(spark, sf_dir), ("doc_id", "chunk_idx"), n // 6)
    c = c.select("doc_id", "chunk_idx", S.capital_tags(F.col("chunk")).alias("tg"), "_block")
    return shared_table(c.select("doc_id", "chunk_idx", "tg.tokens", "tg.tags", "_block"), "tag-sequences")


@register("k3_train_tagger")
def q_train_tagger(spark, sf_dir):
    _, tr, _ = MD.train_tagger(tag_sequences(spark, sf_dir))
    return tr.select("prev_tag", "tag", r6(F.col("logp")).alias("logp"))


@register("k3_tagger_emissions")
def q_tagger_emissions(spark, sf_dir):
    em, _, _ = MD.train_tagger(tag_sequences(spark, sf_dir))
    return em.select("tag", "token", r6(F.col("logp")).alias("logp"))


def path_scores(seqs: DataFrame, em: DataFrame, tr: DataFrame) -> DataFrame:
    """K5 sums of each chunk's own path; equal (tag, token) pairs of a chunk travel as one row."""
    keys = ["doc_id", "chunk_idx"]
    pairs = F.zip_with("tokens", "tags", lambda w, t: F.struct(t.alias("tag"), w.alias("token")))
    e = seqs.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.tag", "p.token").agg(F.count("*").alias("n"))
    e = e.join(em, ["tag", "token"]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("logp")).alias("es"))
    t = exploded(seqs.withColumn("b", MD.tag_bigrams("tags")), "b", *keys).groupBy(*keys, "x.prev_tag", "x.tag").agg(F.count("*").alias("n"))
    t = t.join(F.broadcast(tr), ["prev_tag", "tag"]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("logp")).alias("ts"))
    return e.join(t, keys, "left").select(*keys, MD.path_score(F.col("es"), F.coalesce(F.col("ts"), F.lit(0.0))).alias("score"))


@register("k5_sequence_score")
def q_sequence_score(spark, sf_dir):
    seqs = tag_sequences(spark, sf_dir)
    em, tr, _ = MD.train_tagger(seqs)
    return path_scores(seqs, em, tr).select("doc_id", "chunk_idx", r6(F.col("score")).alias("score"))


@register("k2_train_text_classifier")
def q_train_classifier(spark, sf_dir):
    """K2 + K1 (rows-only): fit on ``labels.quality`` with document text, score every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    model = MD.train_text_classifier(d.join(lab, "doc_id"), num_features=1 << 16)
    scored = MD.score_text(model, d)
    return scored.select("doc_id", r6(F.col("p_pos")).alias("p_pos"), r6(F.col("p_neg")).alias("p_neg"))


# ---------------------------------------------------------------- name evaluation, slot maps
def gold_pred_names(spark, sf_dir) -> DataFrame:
    """gold = distinct F5 names of a document; prediction drops the last one when doc_id % 4 = 0."""
    g = doc_names(spark, sf_dir).select("doc_id", F.array_distinct("names").alias("gold"))
    pred = F.when(F.col("doc_id") % 4 == 0, F.slice("gold", 1, F.greatest(F.size("gold") - 1, F.lit(0)))) \
        .otherwise(F.col("gold"))
    return g.select("doc_id", "gold", pred.alias("pred"))


def is_match(pred, gold):
    """G1: same length and every predicted name in gold."""
    return (F.size(pred) == F.size(gold)) & (F.size(F.array_except(pred, gold)) == 0)


@register("g1_is_match")
def q_is_match(spark, sf_dir):
    g = gold_pred_names(spark, sf_dir)
    return g.select("doc_id", is_match(F.col("pred"), F.col("gold")).alias("matched"))


@register("d18_exact_match_accuracy")
def q_exact_match(spark, sf_dir):
    g = gold_pred_names(spark, sf_dir)
    return g.agg(r6(F.avg(is_match(F.col("pred"), F.col("gold")).cast("double"))).alias("accuracy"),
                 F.count("*").alias("n"))


@register("d18_match_accuracy_named")
def q_exact_match_named(spark, sf_dir):
    """D18 without the documents whose gold list is empty (``count_blank`` off)."""
    g = gold_pred_names(spark, sf_dir).filter(F.size("gold") > 0)
    return g.agg(r6(F.avg(is_match(F.col("pred"), F.col("gold")).cast("double"))).alias("accuracy"),
                 F.count("*").alias("n"))


@register("c6_align_gold_pred")
def q_align(spark, sf_dir):
    g = gold_pred_names(spark, sf_dir)
    gold = g.select("doc_id", joined("gold").alias("gold"))
    pred = g.filter(F.size("pred") > 0).select("doc_id", joined("pred").alias("pred"))
    return gold.join(pred, "doc_id", "full_outer")


@register("b8_select_slots")
def q_select_slots(spark, sf_dir):
    t = tagged_chunks(spark, sf_dir).select("doc_id", "chunk_idx", S.slot_map("spans").alias("slots"))
    return t.select("doc_id", "chunk_idx", *[S.first_slot("slots", k).alias(k.lower())
                                             for k in ("NAME", "STORE", "PHONE", "ADDRESS", "TIME")])


@register("j10_slot_map")
def q_slot_map(spark, sf_dir):
    t = tagged_chunks(spark, sf_dir).select("doc_id", "chunk_idx", S.slot_map("spans").alias("slots"))
    return t.select("doc_id", "chunk_idx", F.size("slots").alias("n_types"),
                    joined(F.coalesce(F.try_element_at("slots", F.lit("NAME")), F.array().cast("array<string>")))
                    .alias("names"))


@register("d19_score_histogram")
def q_score_histogram(spark, sf_dir):
    """D19 with equality similarity (1.0 when gold is empty): extracted post fields vs the written values."""
    p = fixtures.posts(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("post_id"), "c_name", "c_nationkey",
                                                "c_mktsegment")
    k = F.col("post_id")
    gold_store = F.concat(F.col("c_name"), F.lit(" 本店"))
    gold_addr = F.concat(F.lit("No."), k.cast("string"), F.lit(" "), F.col("c_mktsegment"), F.lit(" Road"))
    gold_time = F.concat(F.lit("2019/"), (k % 12 + 1).cast("string"), F.lit("/"), (k % 28 + 1).cast("string"))
    f = T.post_fields("content")
    x = p.join(c, "post_id").select(f.alias("f"), gold_store.alias("gs"), gold_addr.alias("ga"), gold_time.alias("gt"),
                                    F.lit("").alias("gp"))
    sim = lambda pred, gold: F.when(F.trim(gold) == "", 1.0).otherwise((pred == gold).cast("double"))
    score = sum((sim(F.col(f"f.{a}"), F.col(b)) >= 0.8).cast("int")
                for a, b in (("name", "gs"), ("phone", "gp"), ("address", "ga"), ("visit_date", "gt")))
    return M.score_histogram(x.select(score.alias("score")))
