"""The word cache gives the library's ids: every letter beside every kind of sign, and random texts."""
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftkit.llm import tokens
from siftkit.llm.queries import tokenizer

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
TEXTS = 8_000


def both(name):
    lib = Tokenizer.from_file(tokenizer(name))
    lib.encode_special_tokens = True
    return tokens.WordCache(tokenizer(name)), lib


def same(cache, lib, texts):
    want = lib.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, want) if np.frombuffer(cache.encode(t), "<u2").tolist() != e.ids]


@pytest.mark.parametrize("name", NAMES)
def test_every_letter(name):
    cache, lib = both(name)
    letters = [chr(c) for c in (*range(0x41, 0x250), 0x301, 0x3a3, 0x1e9e, 0x1f88, 0xfb01, 0x4e2d, 0xac00, 0x1d400)]
    shapes = ("ab {}.", "ab {}, x", "{}", "a{} b", "{}a.b", "x {}\ny", "{}! {}", " {}", "\n{}.", "{}{}. ", "don't {}'s 1{}2")
    assert same(cache, lib, [s.format(*[c] * s.count("{}")) for c in letters for s in shapes]) == []


@pytest.mark.parametrize("name", NAMES)
def test_random_texts(name):
    cache, lib = both(name)
    rng = random.Random(name)
    pool = ([*"abcdefgETAOIN .,.,!?'\"-()[]:;0123456789\n\t"] + ["  ", "\n\n", " ", ". ", ", ", " the", " word", "ing", "\r\n", "\x0b", "\x1c", "\xa0", " ",
            "​", "﻿", "é", "é", "İ", "ŉ", "Ǆ", "ĳ", "ß", "ſ", "中", "文", "<|endoftext|>", "[UNK]", "##", "😀", "ͅ", "ﬁ", "Σ", "ς", "ª", "¼"]
            + [chr(c) for c in range(0xC0, 0x250)])
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(TEXTS)]
    assert same(cache, lib, texts) == []


@pytest.mark.parametrize("name", NAMES)
def test_full_caches_change_no_id(name, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 3)
    monkeypatch.setattr(tokens, "MAX_WORDS", 3)
    cache, lib = both(name)
    assert same(cache, lib, [f"word{i} same, word{i % 7}. İstanbul Straße" for i in range(200)]) == []
