"""WordPiece over a vocabulary trie with failure links (H6), for use inside Arrow tasks.

A trie holds the tokens that may begin a word, a second one those that may go on (their
``##`` left out).  Where the walk through a word has no next node, the failure link leads to
the node of the longest continuation that the word can still be in, and the pieces that are
thereby settled are known beforehand.  So a word takes time linear in its length, whatever
the vocabulary.  The tries are built once a Python worker.
"""
from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

PIECE_PREFIX = "##"
UNKNOWN = "[UNK]"
MAX_WORD_CHARS = 200
#: A vocabulary is a model's fixed table; it goes to every task, so its size is checked.
MAX_VOCAB = 2_000_000

START, ON, NONE = 0, 1, -1


class WordPieceTrie:
    """``pieces(word)`` gives the ids of the greedy longest pieces, or None if there are none."""

    def __init__(self, vocab: dict[str, int], unknown: str = UNKNOWN, max_chars: int = MAX_WORD_CHARS):
        self.max_chars, self.unknown = max_chars, (vocab.get(unknown),)
        self.next: dict[int, int] = {}  # node and character to node
        own = [None, None]  # the id of the token that ends at a node
        kids: list[list[tuple[int, int]]] = [[], []]
        for token, i in vocab.items():
            going_on = token.startswith(PIECE_PREFIX) and len(token) > len(PIECE_PREFIX)
            for root, text in ((START, token), *([(ON, token[len(PIECE_PREFIX):])] if going_on else [])):
                node = root
                for c in map(ord, text):
                    to = self.next.get(node << 21 | c)
                    if to is None:
                        to = self.next[node << 21 | c] = len(own)
                        own.append(None)
                        kids.append([])
                        kids[node].append((c, to))
                    node = to
                if node != root:
                    own[node] = i
        self.fail = [NONE] * len(own)
        self.settled: list[tuple[int, ...]] = [()] * len(own)
        queue = deque([START, ON])  # nodes by depth: links lead to smaller depths of the second trie
        while queue:
            node = queue.popleft()
            for c, to in kids[node]:
                if own[to] is not None:
                    self.fail[to], self.settled[to] = ON, (own[to],)
                else:
                    at, pieces = self.fail[node], self.settled[node]
                    while at != NONE and (at << 21 | c) not in self.next:
                        pieces, at = pieces + self.settled[at], self.fail[at]
                    if at != NONE:
                        self.fail[to], self.settled[to] = self.next[at << 21 | c], pieces
                queue.append(to)

    def pieces(self, word: str) -> tuple[int, ...]:
        """The ids of the word's pieces; ``unknown`` if some place has none or the word is too long."""
        if len(word) > self.max_chars:
            return self.unknown
        step, fail, settled, node, out = self.next, self.fail, self.settled, START, ()
        for c in map(ord, word):
            while (to := step.get(node << 21 | c)) is None:
                if fail[node] == NONE:
                    return self.unknown
                out, node = out + settled[node], fail[node]
            node = to
        while node != ON:
            if fail[node] == NONE:
                return self.unknown
            out, node = out + settled[node], fail[node]
        return out


_tries: dict[str, tuple[WordPieceTrie, dict]] = {}
#: Words a worker remembers; beyond that it walks the trie anew.
MAX_KNOWN = 50_000
#: Words of a batch that are encoded at a time, about.
WORDS_HELD = 200_000


def _trie(shared) -> tuple[WordPieceTrie, dict]:
    given = shared.value
    if given["key"] not in _tries:
        _tries.clear()
        _tries[given["key"]] = WordPieceTrie(given["vocab"], given["unknown"], given["max_chars"]), {}
    return _tries[given["key"]]


def share_vocab(vocab: DataFrame, unknown: str = UNKNOWN, max_chars: int = MAX_WORD_CHARS):
    """The vocabulary ``(token, id)``, of at most MAX_VOCAB rows, where every task can read it."""
    rows = vocab.select("token", F.col("id").cast("int").alias("id")).limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary of more than {MAX_VOCAB} tokens")
    return vocab.sparkSession.sparkContext.broadcast(
        {"key": uuid.uuid4().hex, "vocab": {r.token: r.id for r in rows}, "unknown": unknown, "max_chars": max_chars})


def encode_lists(lists: pa.ListArray, trie: WordPieceTrie, known: dict) -> pa.ListArray:
    """Lists of words as lists of lists of ids; each distinct word of the batch is walked once."""
    flat = lists.flatten().dictionary_encode()
    distinct = []
    for w in flat.dictionary.to_pylist():
        got = known.get(w)
        if got is None:
            got = trie.pieces(w)
            if len(known) < MAX_KNOWN:
                known[w] = got
        distinct.append(got)
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    ends = np.cumsum(lengths)
    ids = np.fromiter((i for p in distinct for i in p), np.int32, int(lengths.sum()))
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = lengths[at] if len(at) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(own)])
    take = np.repeat((ends - lengths)[at] - offsets[:-1], own) + np.arange(offsets[-1]) if len(at) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[take]))
    outer = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)


def slices(batch: pa.RecordBatch, *words: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about WORDS_HELD words, so that memory does not follow the length of the texts."""
    if batch.num_rows == 0:
        yield batch
        return
    n = sum(batch.column(w).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for w in words)
    run = (np.cumsum(n) - n) // WORDS_HELD
    starts = np.concatenate([np.flatnonzero(np.diff(run, prepend=-1)), [batch.num_rows]])
    for a, b in zip(starts[:-1], starts[1:]):
        yield batch.slice(a, b - a)


def with_flat_ids(df: DataFrame, outs: dict[str, str], shared) -> DataFrame:
    """``df``, each array column of words in ``outs`` replaced by the ids of its words' pieces, one after the other."""
    kept = [f for f in df.schema.fields if f.name not in outs]
    schema = StructType([*kept, *(StructField(o, ArrayType(IntegerType())) for o in outs.values())])

    def flat(lists: pa.ListArray) -> pa.ListArray:
        inner = lists.values
        return pa.ListArray.from_arrays(inner.offsets.take(lists.offsets), inner.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _trie(shared)
        for batch in batches:
            for part in slices(batch, *outs):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *(flat(encode_lists(part.column(w), trie, known)) for w in outs)], names=schema.names)

    return df.mapInArrow(run, schema)


def with_piece_ids(df: DataFrame, words: str, shared, out: str = "word_ids") -> DataFrame:
    """``df`` with ``out``, for each word of the array column ``words`` the ids of its pieces; no row moves.

    A null array gives an empty one.
    """
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(ArrayType(IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _trie(shared)
        for batch in batches:
            for part in slices(batch, words):
                ids = encode_lists(part.column(words), trie, known)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def wordpiece(distinct_tokens: DataFrame, vocab: DataFrame, token: str = "token", unk: str = UNKNOWN,
              max_chars: int = MAX_WORD_CHARS) -> DataFrame:
    """H6: greedy longest-match-first pieces of each distinct token -> ``(token, pieces, ids)``.

    Non-initial pieces carry ``##``; a token with a place no piece matches, or longer than
    ``max_chars``, becomes ``[unk]``.
    """
    shared = share_vocab(vocab, unk, max_chars)
    schema = StructType([StructField("token", StringType()), StructField("pieces", ArrayType(StringType())),
                         StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, _ = _trie(shared)
        by_id = sorted((i, t) for t, i in shared.value["vocab"].items())
        known_ids, names = np.array([i for i, _ in by_id]), pa.array([t for _, t in by_id], pa.string())
        for batch in batches:
            found = [trie.pieces(w) for w in batch.column("token").to_pylist()]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for p in found for i in p), np.int32, int(lengths.sum()))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            pieces = names.take(pa.array(np.searchsorted(known_ids, ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("token"), pa.ListArray.from_arrays(offsets, pieces), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                names=["token", "pieces", "ids"])

    return distinct_tokens.select(F.col(token).alias("token")).distinct().mapInArrow(run, schema)
