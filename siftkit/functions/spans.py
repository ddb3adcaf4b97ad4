"""Tag sequences to spans (E2, E3, H25, J10, B7, B8, D4) as native expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, let, sub

SPAN_TYPE = "array<struct<slot_type:string,text:string,begin:int,end:int>>"

# Fixed value: first letters counted as capitals by the tag fixture.
CAPITAL_RE = "^[A-ZÀ-Þ]"


def tag_type(tag) -> Column:
    """Second ``_`` field of a tag (``B_NAME`` -> ``NAME``), '' when absent."""
    return F.regexp_extract(col(tag), "^[^_]*_([^_]*)", 1)


def _state_changing(tags) -> Column:
    """Positions whose tag can change the decoder state: ``[CLS]``, ``B*`` and ``I*``.

    Other tags (``O``) leave the state as it is, so the scan skips them.
    """
    indexed = F.transform(col(tags), lambda g, i: F.struct(g.alias("tag"), i.alias("j")))
    return F.filter(indexed, lambda x: (x["tag"] == "[CLS]") | x["tag"].startswith("B") | x["tag"].startswith("I"))


def _span_text(pieces: Column, sep: str) -> Column:
    return F.array_join(F.filter(pieces, lambda p: p != ""), sep)


def bio_spans(tokens, tags, sep: str = "") -> Column:
    """Decode one tag sequence into spans, in order.

    Rules: ``[CLS]`` resets (the open span is dropped); ``B_x`` closes the
    open span and starts a new one; ``I_x`` of the open type extends it,
    ``I_x`` of another type closes it and starts a new one, ``I_x`` with no
    open type is ignored; ``O`` and other tags neither end nor reset a span.
    ``#`` is removed from tokens; pieces are joined with ``sep`` ('' for
    character tokens, ' ' for word tokens).  ``begin``/``end`` are the
    positions of the first and last token of the span.
    """
    return let(col(tokens), lambda toks: _bio_spans(toks, tags, sep))  # bound, else each step makes them anew


def _bio_spans(toks: Column, tags, sep: str) -> Column:
    items = _state_changing(tags)
    init = F.struct(
        F.lit("").alias("typ"), F.array().cast("array<string>").alias("pieces"),
        F.lit(-1).alias("b"), F.lit(-1).alias("e"), F.array().cast(SPAN_TYPE).alias("spans"))

    def state(typ, pieces, b, e, spans):
        return F.struct(typ.alias("typ"), pieces.alias("pieces"), b.alias("b"),
                        e.alias("e"), spans.alias("spans"))

    def flushed(acc):
        return F.concat(acc["spans"], F.array(F.struct(
            acc["typ"].alias("slot_type"), _span_text(acc["pieces"], sep).alias("text"),
            acc["b"].alias("begin"), acc["e"].alias("end"))))

    def step(acc, x):
        g, j = x["tag"], x["j"]
        w = F.replace(F.get(toks, j), F.lit("#"), F.lit(""))
        ty = tag_type(g)
        empty = F.array_join(acc["pieces"], "") == ""
        start_new = state(ty, F.array(w), j, j, acc["spans"])
        close_and_start = state(ty, F.array(w), j, j, flushed(acc))
        extend = state(acc["typ"], F.concat(acc["pieces"], F.array(w)), acc["b"], j, acc["spans"])
        reset = state(F.lit(""), F.array().cast("array<string>"), F.lit(-1), F.lit(-1), acc["spans"])
        return (F.when(g == "[CLS]", reset)
                .when(g.startswith("B"), F.when(empty, start_new).otherwise(close_and_start))
                .when(g.startswith("I"),
                      F.when(ty == acc["typ"], extend)
                      .when(acc["typ"] == "", acc)
                      .otherwise(close_and_start))
                .otherwise(acc))

    def finish(acc):
        return F.when(F.array_join(acc["pieces"], "") != "", flushed(acc)).otherwise(acc["spans"])

    return F.aggregate(items, init, step, finish)


def bio_spans_legacy(tokens, tags, sep: str = "") -> Column:
    """The live-path decoder with its quirks.

    The first span's type is the whole tag (``B_NAME``), later spans use the
    short type; ``begin``/``end`` carry the positions current at the flush
    (those of the tag that closes the span).  ``merge_legacy_names`` then
    glues the first ``B_NAME`` span onto the first ``NAME`` span.
    """
    return let(col(tokens), lambda toks: _bio_spans_legacy(toks, tags))


def _bio_spans_legacy(toks: Column, tags) -> Column:
    items = _state_changing(tags)
    init = F.struct(
        F.lit("").alias("typ"), F.lit("").alias("slot"),
        F.lit(-1).alias("b"), F.lit(-1).alias("e"), F.array().cast(SPAN_TYPE).alias("spans"))

    def state(typ, slot, b, e, spans):
        return F.struct(typ.alias("typ"), F.replace(slot, F.lit("#"), F.lit("")).alias("slot"),
                        b.alias("b"), e.alias("e"), spans.alias("spans"))

    def flushed(acc, b, e):
        return F.concat(acc["spans"], F.array(F.struct(
            acc["typ"].alias("slot_type"), acc["slot"].alias("text"),
            b.alias("begin"), e.alias("end"))))

    def step(acc, x):
        g, j = x["tag"], x["j"]
        w = F.get(toks, j)
        ty = tag_type(g)
        b_branch = F.when(acc["slot"] == "", state(g, F.concat(acc["slot"], w), j, j, acc["spans"])) \
            .otherwise(state(ty, w, j, j, flushed(acc, j, j)))
        i_branch = (F.when(ty == acc["typ"], state(acc["typ"], F.concat(acc["slot"], w), acc["b"], j, acc["spans"]))
                    .when(acc["typ"] == "", state(acc["typ"], acc["slot"], acc["b"], j, acc["spans"]))
                    .otherwise(state(ty, w, acc["b"], j, flushed(acc, acc["b"], j))))
        return (F.when(g == "[CLS]", state(F.lit(""), F.lit(""), F.lit(-1), F.lit(-1), acc["spans"]))
                .when(g.startswith("B"), b_branch)
                .when(g.startswith("I"), i_branch)
                .otherwise(acc))

    def finish(acc):
        return F.when(acc["slot"] != "", flushed(acc, acc["b"], acc["e"])).otherwise(acc["spans"])

    return F.aggregate(items, init, step, finish)


def merge_legacy_names(spans, key: str = "NAME") -> Column:
    """E3 post-step: prepend the first ``B_<key>`` span text to the first ``<key>`` span.

    Returns the ``<key>`` span texts; empty when there is no ``<key>`` span
    (a lone one-token first name is lost, as in the reference).
    """
    s = col(spans)
    first_b = F.get(F.filter(s, lambda x: x["slot_type"] == f"B_{key}"), 0)
    names = F.filter(s, lambda x: x["slot_type"] == key)
    texts = F.transform(names, lambda x, i: F.when(
        i == 0, F.concat(F.coalesce(first_b["text"], F.lit("")), x["text"])).otherwise(x["text"]))
    return texts


def capital_tags(chunk, capital_re: str = CAPITAL_RE) -> Column:
    """F4 tag fixture: ``struct(tokens, tags)`` for a chunk split on one space.

    A token whose first letter is a capital is ``B_NAME`` when the token
    before is not capital, else ``I_NAME``; other tokens are ``O``.  A
    ``[CLS]`` leads.  All tokens are tagged, however long the chunk.
    """
    def tagged(toks):
        tags = let(F.transform(toks, lambda w: w.rlike(capital_re)), lambda caps: F.transform(caps, lambda c, i: F.when(
            c, F.when((i > 0) & F.coalesce(F.get(caps, i - 1), F.lit(False)), F.lit("I_NAME"))
            .otherwise(F.lit("B_NAME"))).otherwise(F.lit("O"))))
        return F.struct(F.concat(F.array(F.lit("[CLS]")), toks).alias("tokens"),
                        F.concat(F.array(F.lit("[CLS]")), tags).alias("tags"))

    return let(F.split(col(chunk), " "), tagged)


def span_texts(spans, slot_type: str | None = None) -> Column:
    """Texts of the spans (of one type), in order."""
    s = col(spans)
    if slot_type is not None:
        s = F.filter(s, lambda x: x["slot_type"] == slot_type)
    return F.transform(s, lambda x: x["text"])


def distinct_texts(spans, slot_type: str | None = None) -> Column:
    """Order-preserving distinct span texts."""
    return F.array_distinct(span_texts(spans, slot_type))


def slot_map(spans) -> Column:
    """Spans to ``map<type, array<text>>``, types in order of first appearance."""
    s = col(spans)
    types = F.array_distinct(F.transform(s, lambda x: x["slot_type"]))
    return F.map_from_arrays(types, F.transform(types, lambda ty: span_texts(
        F.filter(s, lambda x: x["slot_type"] == ty))))


def first_slot(slots, key: str) -> Column:
    """First text of a slot type, else ''."""
    return F.coalesce(F.get(F.try_element_at(col(slots), F.lit(key)), 0), F.lit(""))


def fill_unk(article, text) -> Column:
    """Recover ``[UNK]`` characters of a span from the article.

    ``#`` stands for the first unknown, L for the length, p for its index.
    If L > 4 and p < L-1 the text is cut after the unknown.  Then: L > 2 and
    p < L-1: from the first occurrence of the first character to the first
    occurrence (from there) of the text after the unknown, taking one of its
    characters; L > 2 and p = L-1: L characters from the prefix; L = 2 and
    p = 0: the character before the second one plus it; L = 2 and p = 1:
    two characters from the first.  A miss keeps the span text.
    """
    a = col(article)
    t = col(text)
    u0 = F.replace(t, F.lit("[UNK]"), F.lit("#"))
    p = F.position(F.lit("#"), u0) - 1
    n0 = F.length(u0)
    cut = (n0 > 4) & (p < n0 - 1)
    u = F.when(cut, sub(u0, 1, p + 1)).otherwise(u0)
    n = F.when(cut, p + 1).otherwise(n0)

    first = sub(u, 1, 1)
    begin0 = F.position(first, a) - 1
    suffix = sub(u, p + 2, n)
    end0 = F.position(suffix, a, begin0 + 1) - 1
    mid = F.when((begin0 >= 0) & (end0 >= 0), sub(a, begin0 + 1, end0 - begin0 + 1))

    begin1 = F.position(sub(u, 1, p), a) - 1
    tail = F.when(begin1 >= 0, sub(a, begin1 + 1, n))

    end2 = F.position(sub(u, 2, 1), a) - 1
    lead = F.when(end2 > 0, sub(a, end2, 2)).when(end2 == 0, F.lit(""))

    two = F.when(begin0 >= 0, sub(a, begin0 + 1, 2))

    fixed = (F.when((n > 2) & (p < n - 1), mid)
             .when((n > 2) & (p == n - 1), tail)
             .when((n == 2) & (p == 0), lead)
             .when((n == 2) & (p > 0), two))
    return F.when(F.contains(t, F.lit("[UNK]")), F.coalesce(fixed, t)).otherwise(t)
