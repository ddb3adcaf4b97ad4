"""What a step makes once, deals out, or holds at a time; and equal keys in the steps that look tokens up."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftkit.functions import names as N
from siftkit.functions import spans as S
from siftkit.functions import text as T
from siftkit.operators import split, tokens, wordpiece
from siftkit.plans import models as MD
from siftkit.plans import queries as Q

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_chunk_is_split_and_tagged_once(spark):
    df = spark.createDataFrame([("An Ox, a Bee",)], "t string")
    spans = df.select(S.capital_tags("t").alias("g")).select(S.bio_spans("g.tokens", "g.tags", " ").alias("s"))
    assert plan(spans).count("split(t") == 1
    mentions = df.select(N.mention_spans("t", F.lit("e")).alias("m"))
    assert plan(mentions).count("split(t") == 1 and [tuple(m) for m in mentions.first().m] == [(10, 11), (11, 12)]
    chunks = split.split_chunks(spark.createDataFrame([(1, "a. b. c"), (2, None)], "doc_id long, text string"), max_len=4, marks=(".",))
    assert plan(chunks).count("aggregate(") == 1 and {r.doc_id for r in chunks.collect()} == {1}


def test_fields_of_a_post_strip_its_text_once(spark):
    df = spark.createDataFrame([("餐廳名稱：Ox\n電話：02-1234-5678\n",)], "t string")
    assert plan(df.select(T.post_fields("t").alias("f"))).count("regexp_replace(t#") == 1
    assert Q.fixtures.posts(spark, SF_SMALL).rdd.getNumPartitions() >= 4


def test_word_tokens_are_basic_tokens(spark):
    words = ["Ox", "a1", "a-b", "", "中a", "x\n", "é", "­", "a b"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    assert all(r.a == r.b for r in df.select(T.word_tokens("w").alias("a"), T.basic_tokens("w").alias("b")).collect())


def test_normaliser_of_many_equals_one_by_one():
    rng = np.random.default_rng(1)
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    ems = [rng.normal(size=(n, 3)) for n in (4, 0, 1, 7, 4)]

    def plain(em):
        s = start + em[0]
        for row in em[1:]:
            s = np.log(np.exp(s[:, None] + trans).sum(0)) + row
        return np.log(np.exp(s).sum())

    got = MD.normaliser_all(trans, start)([e.ravel() for e in ems])
    assert got == pytest.approx([plain(e) if len(e) else 0.0 for e in ems])


def test_emissions_of_equal_keys_odd_tokens_and_blocks(spark):
    rows = [(1, ["[CLS]", "a"], ["[CLS]", "B"]), (1, ["[CLS]", "a"], ["[CLS]", "B"]), (None, ["[CLS]", "b"], ["[CLS]", "O"]),
            (2, ["[CLS]", "x\x1fy", None, ""], ["[CLS]", "B", "O", "O"]), (3, [], [])]
    seqs = spark.createDataFrame(rows, "k long, tokens array<string>, tags array<string>")
    model = MD.fit_tagger(seqs.where("k = 1 or k is null"), scale=MD.SCALE)
    flat = {r.k: np.reshape(r.flat, (-1, 3)) for r in model.emission_rows(seqs, ("k",)).collect()}
    assert {k: len(v) for k, v in flat.items()} == {1: 4, None: 2, 2: 4}
    assert (flat[1][0] == flat[1][1]).all() and (flat[1][2] == flat[1][3]).all() and (flat[2][1:] == flat[2][3]).all()
    kept = model.decode(seqs, ("k",), keep=("tags",)).collect()
    assert sorted((r.k, len(r.tags), len(r.pred)) for r in kept) == [(1, 2, 4), (1, 2, 4), (2, 4, 4)]
    each = MD.fit_tagger(seqs).log_likelihoods(seqs.where("k = 1"), ("k",)).collect()
    assert len(each) == 2 and each[0] == each[1] and each[0].score <= each[0].z


def test_lookups_move_no_token_and_keep_equal_keys(spark):
    vocab = spark.createDataFrame([("[UNK]", 1), ("b", 4), ("a", 7)], "token string, id long")
    df = spark.createDataFrame([(1, ["a", "z"]), (2, []), (3, None), (4, ["b", "a"]), (4, ["a"])], "doc_id long, tokens array<string>")
    ids = tokens.tokens_to_ids(df, vocab, 1)
    assert "Join" not in plan(ids)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: [7, 1], 2: [], 3: [], 4: [4, 7, 7]}
    with pytest.raises(Exception, match="not in the vocabulary: z"):
        tokens.tokens_to_ids(df, vocab).collect()
    back = tokens.ids_to_tokens(spark.createDataFrame([(1, [7, 9, None]), (2, None), (4, [4, 7]), (4, [7])], "doc_id long, ids array<int>"), vocab)
    assert "Join" not in plan(back)
    assert {r.doc_id: r.tokens for r in back.collect()} == {1: ["a", None, None], 2: [], 4: ["a", "b", "a"]}
    twice = vocab.union(spark.createDataFrame([("c", 7)], vocab.schema))
    assert "Join" in plan(tokens.ids_to_tokens(back.select("doc_id", F.array(F.lit(7)).alias("ids")), twice))


def test_batches_are_encoded_in_runs_of_words(monkeypatch):
    monkeypatch.setattr(wordpiece, "WORDS_HELD", 4)
    batch = pa.record_batch({"w": pa.array([["a"] * n if n is not None else None for n in (3, 2, None, 9, 0, 1)], pa.list_(pa.string()))})
    parts = list(wordpiece.slices(batch, "w"))
    assert len(parts) == 3 and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    trie = wordpiece.WordPieceTrie({"[UNK]": 0, "a": 1})
    assert [x for p in parts for x in wordpiece.encode_lists(p.column("w"), trie, {}).to_pylist()] == [[[1]] * (n or 0) for n in (3, 2, None, 9, 0, 1)]
