"""K6-K9: screen articles for flagged chunks and checked names.

``screen_articles`` runs the whole live path inside each article row:
split (H11) -> chunk score and gate (K7) -> tagging and span decoding (K8)
-> name checks over mention sentences (K6) -> merge (D1-D3).  Every step is
a native higher-order expression, so the plan is one narrow stage: no
shuffle, no Python worker, and an article's chunks never leave its row.
Scores come from scorer callables returning ``struct(p_pos, p_neg)``; the
defaults are the deterministic fixtures F3 and F6.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import LATIN_MARKS, let
from ..functions.gate import keyword_hit, max_rule, rule_check, sum_rule
from ..functions.names import mention_spans, name_ok, unique_names
from ..functions.spans import bio_spans, capital_tags, fill_unk, first_slot, slot_map
from ..functions.splitting import mention_sentence, split_article
from ..operators.split import split_chunks
from ..session import shared_table
from ..sources import fixtures

ChunkScorer = Callable[[Column, Column, Column], Column]   # (doc_id, chunk_idx, chunk)
MentionScorer = Callable[[Column, Column, Column, Column], Column]  # (doc_id, chunk_idx, start, pair_text)


def fixture_chunk_scorer(doc_id, chunk_idx, _chunk) -> Column:
    return fixtures.chunk_score(doc_id, chunk_idx)


def fixture_mention_scorer(doc_id, chunk_idx, start, _pair) -> Column:
    return fixtures.mention_score(doc_id, chunk_idx, start)


def pair_text(name, sentence) -> Column:
    """``name[SEP]sentence``."""
    return F.concat(name, F.lit("[SEP]"), sentence)


def full_text_pair(content, name, max_len: int) -> Column:
    """The first ``max_len - 10`` characters, ``[SEP]`` and the name."""
    c, n = (F.col(x) if isinstance(x, str) else x for x in (content, name))
    return F.concat(F.substring(c, 1, max_len - 10), F.lit("[SEP]"), n)


def place_slots(tagged: DataFrame, key: str, tokens: str, tags: str, sep: str = "") -> DataFrame:
    """K10 from decoded tags (K4 or any tagger): spans (E2), one row of the four place fields."""
    slots = tagged.select(key, slot_map(bio_spans(tokens, tags, sep)).alias("m"))
    return slots.select(key, *(first_slot("m", k).alias(k.lower()) for k in ("STORE", "PHONE", "ADDRESS", "TIME")))


def names_of_tags(tagged: DataFrame, keys: Sequence[str], tokens: str, tags: str, text: str, sep: str = " ",
                  slot_type: str = "NAME") -> DataFrame:
    """K8 from decoded tags: ``(*keys, names)``, spans (E2), ``[UNK]`` recovered from ``text`` (H25), distinct."""
    spans = F.filter(bio_spans(tokens, tags, sep), lambda s: s["slot_type"] == slot_type)
    return tagged.select(*keys, F.array_distinct(F.transform(spans, lambda s: fill_unk(F.col(text), s["text"]))).alias("names"))


def chunk_names(doc_id, chunk_idx, chunk, tagger=capital_tags, sep: str = " ",
                slot_type: str = "NAME") -> Column:
    """K8: tag the chunk, decode spans (E2), recover ``[UNK]`` (H25), distinct names."""
    spans = let(tagger(chunk), lambda tagged: bio_spans(tagged["tokens"], tagged["tags"], sep))
    names = F.transform(F.filter(spans, lambda s: s["slot_type"] == slot_type),
                        lambda s: fill_unk(chunk, s["text"]))
    return F.array_distinct(names)


def name_check(doc_id, chunk_idx, chunk, name, scorer: MentionScorer = fixture_mention_scorer,
               threshold: float = 0.25, marks: Sequence[str] = LATIN_MARKS) -> Column:
    """K6: B1 -> mentions (C4) -> sentences (H14, H15) -> scores -> D5 (D6 when threshold <= 0)."""
    def scored(ms):
        def add(acc, m):
            sent = mention_sentence(chunk, m["start"], m["end"], marks)
            sc = scorer(doc_id, chunk_idx, m["start"], pair_text(name, sent))
            return F.struct((acc["sp"] + sc["p_pos"]).alias("sp"), (acc["sn"] + sc["p_neg"]).alias("sn"),
                            F.greatest(acc["mp"], sc["p_pos"]).alias("mp"),
                            F.greatest(acc["mn"], sc["p_neg"]).alias("mn"))
        init = F.struct(F.lit(0.0).alias("sp"), F.lit(0.0).alias("sn"),
                        F.lit(-1.0).alias("mp"), F.lit(-1.0).alias("mn"))
        tot = F.aggregate(ms, init, add)
        rule = let(tot, lambda t: sum_rule(t["sp"], t["sn"], threshold) if threshold > 0
                   else max_rule(t["mp"], t["mn"]))
        return (F.size(ms) > 0) & rule
    return name_ok(name) & let(mention_spans(chunk, name), scored)


def chunk_result(doc_id, chunk_idx, chunk, keywords: Column | None, adjust: float,
                 keyword_mode: str, chunk_scorer: ChunkScorer, mention_scorer: MentionScorer,
                 threshold: float, marks: Sequence[str], tagger, sep: str) -> Column:
    """One chunk: gate (K7), then names and checked names when it passes."""
    sc = chunk_scorer(doc_id, chunk_idx, chunk)
    hit = keyword_hit(chunk, keywords, keyword_mode) if keywords is not None else None
    flag = rule_check(sc["p_pos"], sc["p_neg"], hit, adjust) == 1
    empty = F.array().cast("array<string>")

    def with_flag(fl):
        names = F.when(fl, chunk_names(doc_id, chunk_idx, chunk, tagger, sep)).otherwise(empty)
        return let(names, lambda nn: F.struct(
            chunk.alias("article"), fl.alias("has_aml"), nn.alias("ner_names"),
            F.filter(nn, lambda n: name_check(doc_id, chunk_idx, chunk, n, mention_scorer,
                                              threshold, marks)).alias("predicted_names")))
    return let(flag, with_flag)


def screen_articles(docs: DataFrame, keywords: DataFrame | None = None, *, doc_id: str = "doc_id",
                    text: str = "text", max_len: int = 511,
                    split_marks: Sequence[str] = LATIN_MARKS, sentence_marks: Sequence[str] = LATIN_MARKS,
                    adjust: float = 0.3, threshold: float = 0.25, keyword_mode: str = "equals",
                    chunk_scorer: ChunkScorer = fixture_chunk_scorer,
                    mention_scorer: MentionScorer = fixture_mention_scorer,
                    tagger=capital_tags, sep: str = " ", do_split: bool = True,
                    with_timestamp: bool = False, with_article: bool = False) -> DataFrame:
    """K9 flagship: one answer row per article.

    Columns: ``doc_id, has_aml, ner_names, names, split_cnt, results``
    (``results`` = chunk results in order), plus ``timestamp`` (epoch ms of
    processing) and ``article`` (the text) when asked.  ``keywords`` is a one-column DataFrame of rule
    keywords (A10); it is reduced to one array value by a scalar subquery,
    so it must be a bounded list.
    """
    d = F.col(doc_id)
    t = F.col(text)
    base = docs
    kw_col = None
    if keywords is not None:
        kw_name = keywords.columns[0]
        kw_array = keywords.select(F.collect_list(F.col(kw_name))).scalar()
        base = base.withColumn("_keywords", kw_array)
        kw_col = F.col("_keywords")
    chunks = split_article(t, max_len, split_marks) if do_split else F.array(t)
    results = F.transform(chunks, lambda c, i: chunk_result(
        d, i, c, kw_col, adjust, keyword_mode, chunk_scorer, mention_scorer, threshold,
        sentence_marks, tagger, sep))

    columns = [d.alias("doc_id"), let(results, merge_results).alias("r")] + ([t.alias("article")] if with_article else [])
    out = base.select(*columns).select("doc_id", "r.*", *(["article"] if with_article else []))
    if with_timestamp:
        out = out.withColumn("timestamp", F.unix_millis(F.current_timestamp()))
    return out


def merge_results(rs) -> Column:
    """An article's answer from its chunk results, in order."""
    has_aml = F.exists(rs, lambda r: r["has_aml"])
    ner = unique_names(F.flatten(F.transform(rs, lambda r: r["ner_names"])))
    picked = unique_names(F.flatten(F.transform(rs, lambda r: r["predicted_names"])))
    names = F.when((F.size(picked) == 0) & has_aml, ner).otherwise(picked)
    return F.struct(has_aml.alias("has_aml"), ner.alias("ner_names"), names.alias("names"),
                    F.size(rs).alias("split_cnt"), rs.alias("results"))


RESULT_TYPE = "array<struct<article:string,has_aml:boolean,ner_names:array<string>,predicted_names:array<string>>>"


def screen_by_model(docs: DataFrame, score_chunks: Callable[[DataFrame], DataFrame],
                    score_mentions: Callable[[DataFrame], DataFrame], keywords: DataFrame | None = None, *,
                    doc_id: str = "doc_id", text: str = "text", max_len: int = 511,
                    split_marks: Sequence[str] = LATIN_MARKS, sentence_marks: Sequence[str] = LATIN_MARKS,
                    adjust: float = 0.3, threshold: float = 0.25, keyword_mode: str = "equals",
                    tagger=capital_tags, sep: str = " ") -> DataFrame:
    """K9 with scores from models: the rows of ``screen_articles``, chunks and mentions as rows.

    ``score_chunks`` gets ``(doc_id, chunk_idx, text)`` and ``score_mentions`` ``(doc_id,
    chunk_idx, name, start, text)``; each adds ``p_pos`` and ``p_neg``, for instance by K1 with a
    fitted pipeline.  Each model makes one pass.  Tagged chunks are written once, since names
    and the merge read them; what is grouped afterwards carries no chunk text but the merge's.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    c = split_chunks(d, "text", max_len, split_marks).withColumnRenamed("chunk", "text")
    hit = None
    scored = score_chunks(c)
    if keywords is not None:
        scored = scored.withColumn("_keywords", keywords.select(F.collect_list(keywords.columns[0])).scalar())
        hit = keyword_hit("text", "_keywords", keyword_mode)
    flag = rule_check("p_pos", "p_neg", hit, adjust) == 1
    empty = F.array().cast("array<string>")
    names = F.when(F.col("has_aml"), chunk_names(F.col("doc_id"), F.col("chunk_idx"), F.col("text"), tagger, sep)).otherwise(empty)
    base = shared_table(scored.withColumn("has_aml", flag).select("doc_id", "chunk_idx", "text", "has_aml", names.alias("names")),
                        "tagged-chunks")
    each = base.select("doc_id", "chunk_idx", "text", F.explode("names").alias("name")).filter(name_ok("name"))
    each = each.select("doc_id", "chunk_idx", "text", "name", F.explode_outer(mention_spans("text", "name")).alias("m")).filter(F.col("m").isNotNull())
    sentence = mention_sentence(F.col("text"), F.col("m.start"), F.col("m.end"), sentence_marks)
    mentions = score_mentions(each.select("doc_id", "chunk_idx", "name", F.col("m.start").alias("start"),
                                          pair_text(F.col("name"), sentence).alias("text")))
    sums = mentions.groupBy("doc_id", "chunk_idx", "name").agg(
        F.sum("p_pos").alias("sp"), F.sum("p_neg").alias("sn"), F.max("p_pos").alias("mp"), F.max("p_neg").alias("mn"))
    passed = sum_rule("sp", "sn", threshold) if threshold > 0 else max_rule("mp", "mn")
    picked = sums.filter(passed).groupBy("doc_id", "chunk_idx").agg(F.collect_set("name").alias("picked"))
    results = base.join(picked, ["doc_id", "chunk_idx"], "left").select("doc_id", "chunk_idx", F.struct(
        F.col("text").alias("article"), "has_aml", F.col("names").alias("ner_names"),
        F.filter("names", lambda n: F.array_contains(F.coalesce("picked", empty), n)).alias("predicted_names")).alias("r"))
    merged = results.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "r"))).alias("l"))
    rs = F.coalesce(F.transform("l", lambda x: x["r"]), F.array().cast(RESULT_TYPE))
    return d.select("doc_id").join(merged, "doc_id", "left").select("doc_id", let(rs, merge_results).alias("m")).select("doc_id", "m.*")
