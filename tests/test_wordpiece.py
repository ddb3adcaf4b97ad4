"""WordPiece by the trie against plain greedy matching; encoders on odd rows."""
import random

import pytest
from pyspark.sql import functions as F

from siftkit.operators import encoders, tokens, wordpiece


def greedy(word, vocab, max_chars=200):
    out, s = [], 0
    while s < len(word) <= max_chars:
        e = next((e for e in range(len(word), s, -1) if ("##" if s else "") + word[s:e] in vocab), None)
        if e is None:
            return (vocab["[UNK]"],)
        out.append(vocab[("##" if s else "") + word[s:e]])
        s = e
    return tuple(out) if len(word) <= max_chars else (vocab["[UNK]"],)


def test_trie_is_greedy_longest_match():
    rng = random.Random(0)
    for _ in range(1500):
        vocab = {"[UNK]": 0}
        for _ in range(rng.randint(1, 25)):
            vocab.setdefault(rng.choice(["", "##"]) + "".join(rng.choices("ab#中", k=rng.randint(1, 5))), len(vocab))
        trie = wordpiece.WordPieceTrie(vocab, max_chars=9)
        for _ in range(20):
            word = "".join(rng.choices("ab#中", k=rng.randint(1, 11)))
            assert trie.pieces(word) == greedy(word, vocab, 9), (vocab, word)


def test_walk_is_linear():
    """The worst word for trying every length at every place."""
    vocab = {"[UNK]": 0, "a": 1, "##a": 2} | {"##" + "a" * k + "b": k for k in range(3, 150)}
    trie = wordpiece.WordPieceTrie(vocab, max_chars=10**6)
    assert trie.pieces("a" * 100_000) == (1, *[2] * 99_999)[:1] + (2,) * 99_999


VOCAB = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "un": 4, "##aff": 5, "##able": 6, "go": 7, ".": 8}


@pytest.fixture(scope="module")
def shared(spark):
    return wordpiece.share_vocab(spark.createDataFrame(list(VOCAB.items()), "token string, id long"))


def test_lists_of_words(spark, shared):
    rows = [(1, ["unaffable", "go"]), (2, []), (3, None), (4, ["x" * 201, "un", "zzz", "unaffable"]), (4, ["go"]), (None, ["."])]
    df = spark.createDataFrame(rows, "k long, w array<string>").repartition(2)
    got = wordpiece.with_piece_ids(df, "w", shared)
    assert sorted((r.k or 0, r.word_ids) for r in got.collect()) == [
        (0, [[8]]), (1, [[4, 5, 6], [7]]), (2, []), (3, []), (4, [[1], [4], [1], [4, 5, 6]]), (4, [[7]])]
    ids = tokens.doc_piece_ids(df, F.col("w"), shared, 1, keys=("k",))
    assert sorted((r.k or 0, r.ids) for r in ids.collect() if r.k != 3) == [(0, [8]), (1, [4, 5, 6]), (2, []), (4, [1]), (4, [7])]
    none = wordpiece.with_piece_ids(df.limit(0), "w", shared)
    assert none.count() == 0 and none.columns == ["k", "w", "word_ids"]


def test_a_vocabulary_that_is_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(wordpiece, "MAX_VOCAB", 3)
    with pytest.raises(ValueError, match="more than 3"):
        wordpiece.share_vocab(spark.range(4).select(F.col("id").cast("string").alias("token"), "id"))


def align(spark, shared, rows, max_len=8, **kw):
    tag_ids = spark.createDataFrame([("B_X", 0), ("I_X", 1), ("O", 2), ("[CLS]", 3)], "tag string, id int")
    df = spark.createDataFrame(rows, "k long, tokens array<string>, tags array<string>")
    return encoders.align_tags(df, shared, tag_ids, lambda w: F.split(w, "-"), max_len, 2, keys=("k",), **kw)


def test_tags_on_pieces(spark, shared):
    """The first piece keeps the tag, later pieces and words of a token get O; cut, padded with O."""
    got = {r.k: r for r in align(spark, shared, [
        (1, ["unaffable", "go-go"], ["B_X", "I_X"]), (2, ["unaffable"] * 4, ["B_X"] * 4), (3, [], []), (4, ["go", "go"], ["I_X"])]).collect()}
    assert got[1].input_ids == [2, 4, 5, 6, 7, 7, 0, 0] and got[1].tag_ids == [3, 0, 2, 2, 1, 2, 2, 2] and got[1].n_real == 6
    assert got[1].input_mask == [1] * 6 + [0] * 2 and got[1].segment_ids == [0] * 8
    assert got[2].input_ids == [2, 4, 5, 6, 4, 5, 6, 4] and got[2].tag_ids == [3, 0, 2, 2, 0, 2, 2, 0] and got[2].n_real == 8
    assert got[3].input_ids == [2] + [0] * 7 and got[3].tag_ids == [3] + [2] * 7
    assert got[4].input_ids[:3] == [2, 7, 0] and got[4].tag_ids[:3] == [3, 1, 2]
    bare = align(spark, shared, [(1, ["go"], ["B_X"])], lead=None).first()
    assert bare.input_ids[:2] == [7, 0] and bare.tag_ids[:2] == [0, 2]


def test_an_unknown_tag_raises(spark, shared):
    with pytest.raises(Exception, match="not a known tag: B_Y"):
        align(spark, shared, [(1, ["go"], ["B_Y"])]).collect()
