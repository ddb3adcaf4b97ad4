"""Queries that SQL cannot express, over whole sf0.001 tables, against plain Python."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import regex

import corpus_pipeline
from siftkit.llm import language_id, mixing, toxicity
from siftkit.llm.common import documents
from siftkit.llm.queries import REGISTRY, tokenizer
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in documents(spark, SF_SMALL).collect()}


@cache
def library(name):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer(name))
    lib.encode_special_tokens = True
    return lib


def ids_of(name, text, end):
    return np.array([*library(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def shingle_set(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(sets):
    """Pairs of positions whose sets have a Jaccard similarity of 0.8 or more, by an inverted index."""
    found, where = [], defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(where[g])
            where[g].append(i)
        found += [(j, i) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
    return found


def classes_of(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def check_packing(got, texts):
    """Every text's pieces, exactly, and sequences without gaps; texts may repeat."""
    want = Counter()
    for doc_id, text in texts:
        ids = ids_of("word_bpe_49k.json", text, 1)
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[doc_id, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places), sum(r.length for r in got) / 4096


def test_packing(spark, rows):
    used, least = check_packing(REGISTRY["op3_pattern_packing"](spark, SF_SMALL).collect(), [(k, r.text) for k, r in rows.items()])
    assert used <= least * 1.01 + 1


def test_token_files(spark, rows):
    got, start = sorted(REGISTRY["op5_token_files"](spark, SF_SMALL).collect()), 0
    assert [r.doc_id for r in got] == sorted(rows)
    for r in got:
        ids = ids_of("byte_bpe_50k.json", rows[r.doc_id].text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_two_pass_shuffle(spark, rows):
    got = REGISTRY["op6_two_pass_shuffle"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        raw = (rows[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3
    again = REGISTRY["op6_two_pass_shuffle"](spark, SF_SMALL).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_jaccard_join(spark, rows):
    got = {r.doc_id: r for r in REGISTRY["op7_jaccard_join"](spark, SF_SMALL).collect()}
    first = {}
    for k in sorted(rows):
        first.setdefault(shingle_set(rows[k].text), k)
    sets = list(first)
    pairs = similar_pairs(sets)
    links = Counter(i for p in pairs for i in p)
    cls = classes_of(len(sets), pairs)
    at = {s: i for i, s in enumerate(sets)}
    for k, r in rows.items():
        i = at[shingle_set(r.text)]
        assert (got[k].class_id, got[k].copy_id, got[k].links) == (first[sets[cls[i]]], first[sets[i]], links[i])


def test_language(spark, rows):
    got = REGISTRY["op9_word_first_language"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows) and all(r.held_out == held_out(r.doc_id) for r in got)
    lettered = [r for r in got if r.held_out and re.search(r"[^\W\d_]", rows[r.doc_id].text or "")]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in lettered]) >= 0.95


def test_language_against_plain_python(spark, rows):
    """Counts, log frequencies, back-off and softmax made anew from the rows outside the held-out fold."""
    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for k, r in rows.items():
        if r.text is not None and r.lang is not None and not held_out(k):
            for w in regex.findall(r"\p{L}+", r.text.lower()):
                words[w][r.lang] += 1
    for w, c in words.items():
        for n in range(1, 6):
            for i in range(len(w) + 2 - n + 1):
                grams[n][f"^{w}$"[i:i + n]].update(c)
    langs = sorted({x for c in words.values() for x in c})
    ranked = sorted(((-sum(c.values()), g, n) for n in grams for g, c in grams[n].items()))[:language_id.MAX_GRAMS]
    kept = {n: {g for _, g, m in ranked if m == n} for n in grams}
    top = {w for _, w in sorted((-sum(c.values()), w) for w, c in words.items())[:language_id.MAX_WORDS]}

    def logs(counts, total, kinds):
        return np.array([np.log((counts[x] + 0.1) / (total[x] + 0.1 * kinds)) for x in langs])

    # the smoothing counts a word or n-gram once for every language that has it
    kinds = sum(len(words[w]) for w in top) + 1
    gram_kinds = {n: sum(len(grams[n][g]) for g in kept[n]) + 1 for n in grams}
    total = sum(words.values(), Counter())
    totals = {n: sum(grams[n].values(), Counter()) for n in grams}

    @cache
    def row(w):
        if w in top:
            return logs(words[w], total, kinds)
        marked = f"^{w}$"
        for n in range(5, 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := marked[i:i + n]) in kept[n]]
            if known:
                return np.mean([logs(grams[n][g], totals[n], gram_kinds[n]) for g in known], axis=0)
        return np.zeros(len(langs))

    for r in REGISTRY["op9_word_first_language"](spark, SF_SMALL).collect():
        found = re.findall(r"[^\W\d_]+", (rows[r.doc_id].text or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = sum(row(w) for w in found)
        assert r.lang_pred == langs[int(np.argmax(s))] and abs(r.score - 1 / np.exp(s - s.max()).sum()) < 1e-6


def test_toxicity_ranks_held_out_rows(spark, rows):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in documents(spark, sf, "labels").collect()}
    got = [r for r in REGISTRY["op10_pu_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    bad, good = ([r.score for r in got if toxic[r.doc_id] == t] for t in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) >= 0.7


def test_fingerprint_of_copies(spark, rows):
    got = {r.doc_id: r for r in REGISTRY["op8_multiset_hash"](spark, SF_SMALL).collect()}
    by_text = defaultdict(set)
    for k, r in rows.items():
        by_text[r.text].add(got[k].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert np.median([r.near_edited for r in got.values()]) > 3 * np.median([r.near_next for r in got.values()])


def test_pipeline(spark, rows):
    """The rows of run(), from a plain walk through the stages; the toxicity model is the trained one."""
    docs = documents(spark, SF_SMALL)
    model = toxicity.train(docs, documents(spark, SF_SMALL, "labels"))
    kept = [k for k in sorted(rows) if model.score(rows[k].text) < 0.5]
    first = {}
    for k in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[k].text or ""), k)
    kept = sorted(first.values())
    seen = {}
    for k in kept:
        seen.setdefault(shingle_set(rows[k].text), k)
    sets = list(seen)
    cls = classes_of(len(sets), similar_pairs(sets))
    kept = [seen[sets[i]] for i in range(len(sets)) if cls[i] == i]
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", rows[k].text or "")) for k in kept}
    total = Counter()
    for k in kept:
        total[rows[k].source] += size[k]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(total))}
    capped = set()
    while True:  # the excess over 3 times a source's size goes to the rest
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in total if s not in capped)
        over = {s for s in total if s not in capped and weight[s] * level > 3 * total[s]}
        if not over:
            break
        capped |= over
    def copies(k, draw):
        s = rows[k].source
        rate = (3 * total[s] if s in capped else weight[s] * level) / total[s] if total[s] else 0
        number = int(hashlib.sha256(f"{mixing.SEED}:{k}".encode()).hexdigest()[8 * draw:8 * draw + 8], 16) / 2 ** 32
        return int(rate) + (number < rate - int(rate))

    mixed = []
    for s in total:
        own = [k for k in kept if rows[k].source == s]
        aim = min(weight[s] * level, 3 * total[s])
        draw = min(range(mixing.DRAWS), key=lambda d: abs(sum(size[k] * copies(k, d) for k in own) - aim))
        mixed += [(k, rows[k].text) for k in own for _ in range(copies(k, draw))]
    used, least = check_packing(corpus_pipeline.run(spark, SF_SMALL).collect(), mixed)
    assert used <= least * 1.01 + 1
