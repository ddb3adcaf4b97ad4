"""Label lookups (C3), pair encoding (J2), tag alignment on pieces (J5), joint loss (I9), metric rows."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import col
from .tokens import truncate_pair
from .wordpiece import with_piece_ids


def map_labels(df: DataFrame, label_map: DataFrame, values: str, source: str, target: str, key: str) -> DataFrame:
    """``(key, mapped)``, each element of the array ``values`` looked up in ``label_map``.

    A row sends each distinct value once, with its places; Spark picks the join by the map's
    size.  A value the map lacks gives null.
    """
    t = df.select(key, F.explode_outer(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("pos")))).alias("x"))
    t = t.groupBy(key, F.col("x.v").alias(source)).agg(F.collect_list("x.pos").alias("at"))
    j = t.join(label_map.select(source, target), source, "left")
    g = j.groupBy(key).agg(F.collect_list(F.struct("at", F.col(target).alias("to"))).alias("l"))
    each = F.flatten(F.transform("l", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("pos"), x["to"].alias("to")))))
    return g.select(key, F.transform(F.sort_array(each), lambda x: x["to"]).alias("mapped"))


def encode_pair(a, b, cls_id: int, sep_id: int, max_len: int) -> Column:
    """``[CLS] a [SEP] b [SEP]`` with segments 0 and 1, J3 with ``max_len - 3``, zero padded."""
    t = truncate_pair(a, b, max_len - 3)
    ids = F.concat(F.array(F.lit(cls_id)), t["a"], F.array(F.lit(sep_id)), t["b"], F.array(F.lit(sep_id)))
    ones = F.size(t["b"]) + 1
    pad = F.array_repeat(F.lit(0), F.lit(max_len) - F.size(ids))
    return F.struct(F.concat(ids, pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size(ids)), pad).alias("input_mask"),
                    F.concat(F.array_repeat(F.lit(0), F.size(ids) - ones), F.array_repeat(F.lit(1), ones), pad).alias("segment_ids"))


def align_tags(seqs: DataFrame, shared, tag_ids: DataFrame, tokenizer: Callable[[Column], Column], max_len: int, cls_id: int,
               tokens: str = "tokens", tags: str = "tags", outside: str = "O", lead: str | None = "[CLS]",
               keys: Sequence[str] = ("doc_id", "chunk_idx")) -> DataFrame:
    """``(*keys, n_real, input_ids, input_mask, segment_ids, tag_ids)`` of tagged tokens.

    Each token is cut into words by ``tokenizer`` and these into the vocabulary's pieces
    (``shared``, from ``share_vocab``).  A token's first piece keeps its tag, all later ones get
    ``outside``.  ``lead``, if given, comes first with a tag of its own name.  What is over
    ``max_len`` is cut; padding has id 0 and the tag ``outside``.  Surplus tokens or tags are left
    out.  ``tag_ids`` is ``(tag, id)``, a row a tag; a tag that it lacks raises.
    """
    n = F.least(F.size(tokens), F.size(tags))
    both = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tags, F.lit(1), n), lambda w, t: F.transform(
        tokenizer(w), lambda p, i: F.struct(p.alias("word"), F.when(i == 0, t).otherwise(F.lit(outside)).alias("tag"))))
    words = seqs.select(*keys, F.flatten(both).alias("_m")).select(*keys, F.col("_m.word").alias("_words"), F.col("_m.tag").alias("_tags"))
    ided = with_piece_ids(words, "_words", shared).withColumn(
        "_map", tag_ids.select(F.map_from_entries(F.collect_list(F.struct("tag", F.col("id").cast("int"))))).scalar())
    pieces = F.flatten(F.zip_with("word_ids", "_tags", lambda ids, t: F.transform(
        ids, lambda x, i: F.struct(x.alias("id"), F.when(i == 0, t).otherwise(F.lit(outside)).alias("tag")))))
    if lead is not None:
        pieces = F.concat(F.array(F.struct(F.lit(cls_id).alias("id"), F.lit(lead).alias("tag"))), pieces)
    cut = ided.select(*keys, "_map", F.slice(pieces, 1, max_len).alias("_p"))

    def tag_id(tag: Column) -> Column:
        return F.coalesce(F.try_element_at("_map", tag), F.raise_error(F.concat(F.lit("not a known tag: "), tag)).cast("int"))

    pad = F.lit(max_len) - F.size("_p")
    zeros = F.array_repeat(F.lit(0), pad)
    return cut.select(*keys, F.size("_p").alias("n_real"), F.concat("_p.id", zeros).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("_p")), zeros).alias("input_mask"),
                      F.array_repeat(F.lit(0), max_len).alias("segment_ids"),
                      F.concat(F.transform("_p.tag", tag_id), F.array_repeat(tag_id(F.lit(outside)), pad)).alias("tag_ids"))


def line_tagger(field_tags: Sequence[tuple[str, str]], outside: str = "O") -> Callable[[Column], Column]:
    """A tagger over lines: ``struct(tokens, tags)``, a line that opens with a field word is ``B_<type>``."""
    def tag(text: Column) -> Column:
        lines = F.split(text, "\n")

        def one(line):
            out = F.lit(outside)
            for word, kind in reversed(field_tags):
                out = F.when(line.startswith(word), F.lit(f"B_{kind}")).otherwise(out)
            return out
        return F.struct(F.concat(F.array(F.lit("[CLS]")), lines).alias("tokens"),
                        F.concat(F.array(F.lit("[CLS]")), F.transform(lines, one)).alias("tags"))
    return tag


def joint_loss(tagged: DataFrame, log_likelihood: str, intents: DataFrame, loss: str, alpha: float) -> DataFrame:
    """``alpha * sum(-log-likelihood) + (1 - alpha) * mean(intent loss)``, one row."""
    a = tagged.agg(F.sum(-F.col(log_likelihood)).alias("a"))
    b = intents.agg(F.avg(loss).alias("b"))
    return a.select((F.col("a") * alpha + b.select("b").scalar() * (1 - alpha)).alias("joint_loss"))


def as_metrics(df: DataFrame, part: str, name: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows ``(part, metric, key, value)``, one for each value column of ``df``."""
    key = F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)) if keys else F.lit("")
    each = F.explode(F.array(*(F.struct(F.lit(f"{name}.{v}").alias("metric"), F.col(v).cast("double").alias("value")) for v in values)))
    return df.select(F.lit(part).alias("part"), key.alias("key"), each.alias("m")).select("part", "m.metric", "key", "m.value")
