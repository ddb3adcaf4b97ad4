"""Vocabulary and encoders (A7, H7, C1, C2, J1-J4, J9, F3); WordPiece itself (H6) is in ``wordpiece``.

Pieces are looked up where the documents lie, so encoding moves no row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.common import col
from ..session import shared_table
from .order import line_numbers
from .wordpiece import MAX_VOCAB, PIECE_PREFIX, with_flat_ids

# Special tokens of the vocabulary.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")


def parse_vocab(lines: DataFrame) -> DataFrame:
    """``(line_no, value)`` -> ``(token, id)``; id = line number, tokens trimmed, a repeated token keeps its last id."""
    return lines.groupBy(F.regexp_replace("value", r"^\s+|\s+$", "").alias("token")).agg(F.max("line_no").alias("id"))


def read_vocab(spark, path: str) -> DataFrame:
    """A7 over files, in file order; a file is read by as many tasks as it has splits."""
    return parse_vocab(line_numbers(spark.read.text(path)))


def token_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(w, count)`` of every distinct token of ``docs``, written once; both a vocabulary and H6 read it."""
    return shared_table(docs.select(F.explode(tokens).alias("w")).groupBy("w").count(), "token-counts")


def build_vocab(docs: DataFrame, tokens: Column, n_words: int, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """specials, every character of the corpus, their ``##`` forms, then the ``n_words``
    most frequent tokens (count desc, token asc); ``(token, id)``, a repeated token keeping its last id.

    ``counts`` is ``token_counts`` of the same tokens, where there is one already.  The alphabet is
    read from the texts once and written.  Bounded by construction: 4 + 2 x alphabet + n_words rows.
    """
    spark = docs.sparkSession
    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            seen.update(*(t for t in batch.column(0).to_pylist() if t))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["c"])

    chars = shared_table(docs.select(text).mapInArrow(letters, "c string").distinct(), "alphabet")
    if counts is None:
        counts = token_counts(docs, tokens)
    words = (counts.orderBy(F.col("count").desc(), F.col("w")).limit(n_words)
             .select("w", (F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("w"))) - 1).alias("r")))
    specials = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in SPECIAL_TOKENS])).alias("id", "token"))
    ranked_chars = chars.select("c", (F.row_number().over(Window.orderBy("c")) - 1).alias("r"))
    n_chars = F.lit(chars.count())
    base = F.lit(len(SPECIAL_TOKENS))
    rows = (specials.select("token", F.col("id").cast("long").alias("id"))
            .unionByName(ranked_chars.select(F.col("c").alias("token"), (base + F.col("r")).alias("id")))
            .unionByName(ranked_chars.select(F.concat(F.lit(PIECE_PREFIX), "c").alias("token"),
                                             (base + n_chars + F.col("r")).alias("id")))
            .unionByName(words.select(F.col("w").alias("token"), (base + 2 * n_chars + F.col("r")).alias("id"))))
    return rows.groupBy("token").agg(F.max("id").alias("id"))


def doc_piece_ids(docs: DataFrame, tokens: Column, shared, max_tokens: int | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The tokens of each row (a model's first ``max_tokens``, if given) -> ordered piece ids ``(*keys, ids)``.

    ``shared`` is the vocabulary from ``share_vocab``.  Rows without tokens give an empty array.
    """
    t = docs.select(*keys, (tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)).alias("_words"))
    return with_flat_ids(t, {"_words": "ids"}, shared)


def tokenize_corpus(docs: DataFrame, tokens: Column, shared, vocab: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """H7: ``(*keys, pos, piece, id)``, a row for every piece of every document, in order."""
    rows = doc_piece_ids(docs, tokens, shared, keys=keys).select(*keys, F.posexplode("ids").alias("pos", "id"))
    names = F.broadcast(vocab.select(F.col("token").alias("piece"), F.col("id").cast("int").alias("id")))  # share_vocab bounds it
    return rows.join(names, "id").select(*keys, "pos", "piece", "id")


def piece_counts(docs: DataFrame, tokens: Column, shared, vocab: DataFrame) -> DataFrame:
    """H7: ``(piece, id, n)``, how often the corpus has each piece; ids are counted before they are named."""
    ids = doc_piece_ids(docs, tokens, shared, keys=()).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.join(vocab.select(F.col("token").alias("piece"), F.col("id").cast("int").alias("id")), "id").select("piece", "id", "n")


def vocab_rows(vocab: DataFrame) -> list[tuple[str, int]] | None:
    """The vocabulary, if it has at most MAX_VOCAB tokens and names each token and id once."""
    rows = [(r.token, r.id) for r in vocab.select("token", F.col("id").cast("int").alias("id")).limit(MAX_VOCAB + 1).collect()]
    once = all(len({x for x in xs if x is not None}) == len(rows) for xs in ([t for t, _ in rows], [i for _, i in rows]))
    return rows if len(rows) <= MAX_VOCAB and once else None


def looked_up(lists: DataFrame, known: pa.Array, values: pa.Array, kind: str, default: int | None = None, strict: bool = False) -> DataFrame:
    """``lists`` with each element of the arrays in its array ``l`` replaced by the value at its place in ``known``."""
    schema = StructType([*(f for f in lists.schema.fields if f.name != "l"), *StructType.fromDDL(f"l {kind}").fields])
    shared = lists.sparkSession.sparkContext.broadcast((known, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            outer = batch.column("l")
            inner = outer.flatten()
            flat = inner.flatten()
            got = values.take(pc.index_in(flat, value_set=known))
            if strict and got.null_count:
                raise ValueError(f"not in the vocabulary: {flat.filter(got.is_null())[0]}")
            ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]), pa.int32())
            l = pa.ListArray.from_arrays(ends(outer), pa.ListArray.from_arrays(ends(inner), got if default is None else got.fill_null(default)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), l], names=schema.names)

    return lists.select(*schema.names).mapInArrow(run, schema)


def merged(lists: DataFrame, key: str, out: str, kind: str) -> DataFrame:
    """``(key, out)``: the arrays in ``l`` as one, place by place; mostly there is one."""
    each = F.flatten(F.transform("l", lambda x: F.transform(x, lambda v, i: F.struct(i.alias("pos"), v.alias("v")))))
    one = F.coalesce(F.get("l", 0), F.array().cast(kind))
    return lists.select(key, F.when(F.size("l") <= 1, one).otherwise(F.transform(F.sort_array(each), lambda x: x["v"])).alias(out))


def tokens_to_ids(df: DataFrame, vocab: DataFrame, unk_id: int | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, tokens)`` -> ``(key, ids)`` by exact lookup; an unknown token gets ``unk_id``, or raises if none is given."""
    rows = vocab_rows(vocab)
    if rows is not None:
        ids = looked_up(df.select(key, F.array("tokens").alias("l")), pa.array([t for t, _ in rows], pa.string()),
                        pa.array([i for _, i in rows], pa.int32()), "array<array<int>>", unk_id, unk_id is None)
        return merged(ids.select(key, F.get("l", 0).alias("l")).groupBy(key).agg(F.collect_list("l").alias("l")), key, "ids", "array<int>")
    t = df.select(key, F.explode_outer(F.transform("tokens", lambda w, i: F.struct(w.alias("token"), i.alias("pos")))).alias("x"))
    t = t.groupBy(key, F.col("x.token").alias("token")).agg(F.collect_list("x.pos").alias("at"))
    j = t.join(vocab.select("token", F.col("id").cast("int").alias("id")), "token", "left")
    unknown = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col("token"))).cast("int") if unk_id is None else F.lit(unk_id)
    g = j.groupBy(key).agg(F.collect_list(F.struct("at", F.when(F.size("at") == 0, F.lit(None).cast("int")).otherwise(
        F.coalesce("id", unknown)).alias("id"))).alias("l"))
    each = F.flatten(F.transform("l", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("pos"), x["id"].alias("id")))))
    return g.select(key, F.transform(F.sort_array(each), lambda x: x["id"]).alias("ids"))


def ids_to_tokens(ids: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` -> ``(key, tokens)`` by the vocabulary's inverse; ids it lacks give null.

    Looked up where the documents lie; with a vocabulary of over MAX_VOCAB tokens a document sends
    each distinct id once, with its places, to a join.
    """
    rows = vocab_rows(vocab)
    if rows is not None:
        grouped = ids.select(key, F.col("ids").cast("array<int>").alias("ids")).groupBy(key).agg(F.collect_list("ids").alias("l"))
        names = looked_up(grouped, pa.array([i for _, i in rows], pa.int32()), pa.array([t for t, _ in rows], pa.string()), "array<array<string>>")
        return merged(names, key, "tokens", "array<string>")
    t = ids.select(key, F.explode_outer(F.transform("ids", lambda v, i: F.struct(v.alias("id"), i.alias("pos")))).alias("x"))
    t = t.groupBy(key, F.col("x.id").alias("id")).agg(F.collect_list("x.pos").alias("at"))
    j = t.join(vocab.select(F.col("id").cast("int").alias("id"), "token"), "id", "left")
    g = j.groupBy(key).agg(F.collect_list(F.struct("at", "token")).alias("l"))
    each = F.flatten(F.transform("l", lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("pos"), x["token"].alias("token")))))
    return g.select(key, F.transform(F.sort_array(each), lambda x: x["token"]).alias("tokens"))


def truncate_pair(a, b, m) -> Column:
    """Lengths after popping from the longer list (``b`` on ties) until ``la + lb <= m``.

    Closed form of the pop loop: ``la' = min(la, max(ceil(m/2), m-lb))``,
    ``lb' = min(lb, max(floor(m/2), m-la))`` when ``la + lb > m``.
    """
    la, lb = F.size(col(a)), F.size(col(b))
    mm = col(m) if not isinstance(m, int) else F.lit(m)
    over = la + lb > mm
    la2 = F.when(over, F.least(la, F.greatest(F.ceil(mm / 2).cast("int"), mm - lb))).otherwise(la)
    lb2 = F.when(over, F.least(lb, F.greatest(F.floor(mm / 2).cast("int"), mm - la))).otherwise(lb)
    return F.struct(F.slice(col(a), 1, la2).alias("a"), F.slice(col(b), 1, lb2).alias("b"))


def encode_ids(ids, cls_id, sep_id, max_len: int, with_sep: bool = True, segments=None) -> Column:
    """``[CLS] ids [SEP]`` (J4: no ``[SEP]``), cut to ``max_len``, zero padded.

    Returns ``struct(input_ids, input_mask, segment_ids)``.
    """
    body = F.slice(col(ids), 1, max_len - (2 if with_sep else 1))
    full = F.concat(F.array(cls_id), body, F.array(sep_id)) if with_sep else F.concat(F.array(cls_id), body)
    n = F.size(full)
    pad = F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0)))
    seg = segments if segments is not None else F.array_repeat(F.lit(0), n)
    return F.struct(F.concat(full, pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), n), pad).alias("input_mask"),
                    F.concat(seg, pad).alias("segment_ids"))
