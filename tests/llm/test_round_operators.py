"""Operators 11 to 13 over whole tables and odd rows, against plain Python."""
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftkit.llm import ffd_packing, periodic_runs, threshold_kmeans
from siftkit.llm.common import documents
from siftkit.llm.queries import REGISTRY, tokenizer
from tests.conftest import SF_SMALL
from tests.llm.test_brute_force import ids_of
from tests.llm.test_edge_cases import ROWS, SCHEMA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 11: periodic runs
def edited_words(doc_id, text):
    """The contract's words, one by one."""
    words = [w.decode() for w in (text or "").encode().split()]
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def runs_of(words, least=12):
    """Every run, each period tried at every place (numpy finds where words p apart agree)."""
    names = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words])
    found = {}
    for p in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[p:] == ids[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + p >= max(least, 2 * p):
                found.setdefault((a, b - a + p), p)
    return sorted((start, length, p) for (start, length), p in found.items())


def report_of(words):
    runs = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if not runs else 1000 * best[1] // best[2]
    return (len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_the_table(spark):
    got = REGISTRY["op11_periodic_runs"](spark, SF_SMALL).collect()
    want = Counter((r.doc_id, *report_of(edited_words(r.doc_id, r.text))) for r in documents(spark, SF_SMALL).collect())
    assert Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got) == want
    assert sum(r.n_runs > 0 for r in got) > 15


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, k, n))) for k, n in ((1, 900), (2, 700), (3, 400), (2, 12), (1, 11), (1, 12), (30, 300))]
    line = " ".join(map(str, rng.integers(0, 1000, 150)))
    texts += [" ".join([line] * 5), f"x {line}  {line}\n{line} y", "a b " * 600 + "c d e " * 300]
    return ROWS + [(100 + i, t, *[None] * 8) for i, t in enumerate(texts)] + [(100, texts[0], *[None] * 8)]


@pytest.mark.parametrize("max_words", [1 << 20, 64])
def test_periodic_runs_of_odd_rows(spark, odd, max_words):
    """With 64 words a piece nearly all documents are dealt out as tiles."""
    docs = spark.createDataFrame(odd, SCHEMA).repartition(3)
    got = periodic_runs.digest(periodic_runs.find_runs(docs, max_words=max_words)).collect()
    want = Counter((r[0], *report_of([w.decode() for w in (r[1] or "").encode().split()])) for r in odd if r[1] is None or len(r[1]) < 50_000)
    long = [r[0] for r in odd if r[1] is not None and len(r[1]) >= 50_000]  # too many words to try all periods; they all differ
    rows = Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got if r.doc_id not in long)
    assert rows == want
    assert [(r.n_runs, r.start, r.collapsed_sha256) for r in got if r.doc_id in long] == [(0, None, sha(" ".join(odd[7][1].split())))]


def test_periodic_runs_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.digest(periodic_runs.find_runs(periodic_runs.repeat_tail(none))).count() == 0


def test_runs_are_exact_for_any_pieces():
    rng = np.random.default_rng(7)
    for round_ in range(60):
        texts = []
        for _ in range(6):
            n, k = int(rng.integers(0, 260)), int(rng.choice([1, 2, 3, 40]))
            w = rng.integers(0, k, n)
            if n and rng.random() < 0.6:
                a = int(rng.integers(0, n))
                p = 1 + int(rng.integers(0, max(1, (n - a) // 2)))
                w[a:] = w[a + np.arange(n - a) % p]
            texts.append(w)
        ids = [w + 1000 * i for i, w in enumerate(texts)]
        n = np.array([len(w) for w in ids])
        flat = np.concatenate(ids)
        whole = periodic_runs.solve(flat, np.cumsum(n) - n, n, 0 * n, n, None)
        cut = []
        for i, w in enumerate(ids):
            for octave, lo, hi in periodic_runs._pieces(len(w), int(rng.choice([5, 32, 100]))):
                s = periodic_runs.spacing(octave)
                base = max(0, lo - s) // s * s
                part = w[base:hi + s + 2 * octave]
                got = periodic_runs.solve(part, np.zeros(1, np.int64), *(np.array([x]) for x in (len(part), lo - base, hi - base, octave)))
                cut += [(i, p, a + base, b + base) for _, p, a, b in got.tolist()]
        for rows in (whole.tolist(), periodic_runs.stitch(np.array(cut, np.int64).reshape(-1, 4)).tolist()):
            found = [{} for _ in texts]
            for i, p, a, b in rows:
                if b - a >= max(p, 12 - p):
                    found[i][a, b - a + p] = min(p, found[i].get((a, b - a + p), p))
            assert [sorted((s, length, p) for (s, length), p in f.items()) for f in found] == [runs_of(w.tolist()) for w in texts], round_


def test_z_function():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(0, int(rng.choice([1, 2, 4])), int(rng.integers(1, 120))).tolist()
        z = periodic_runs.z_function(s)
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


# ---------------------------------------------------------------- 12: first-fit decreasing
def test_first_fit_is_the_plain_one():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = sorted(rng.integers(1, int(rng.choice([5, 60, 101])), int(rng.integers(1, 200))).tolist(), reverse=True)
        used, want = [], []
        for n in lengths:
            i = next((i for i, u in enumerate(used) if u + n <= 100), len(used))
            if i == len(used):
                used.append(0)
            want.append((i, used[i]))
            used[i] += n
        assert ffd_packing.first_fit(lengths, 100) == want


def check_pieces(got, texts):
    want = Counter()
    for doc_id, text in texts:
        ids = ids_of("word_bpe_49k.json", text, 1)
        for start in range(0, len(ids), 2048):
            part = ids[start:start + 2048]
            want[doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), sum(r.length for r in got) / 2048


def test_first_fit_packing_of_the_table(spark):
    texts = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).collect()]
    used, least = check_pieces(REGISTRY["op12_first_fit_packing"](spark, SF_SMALL).collect(), texts)
    assert used <= least * 1.01 + 1


def test_first_fit_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    check_pieces(ffd_packing.pack(docs, tokenizer("word_bpe_49k.json"), group=4).collect(), [(r[0], r[1]) for r in ROWS])
    assert ffd_packing.pack(spark.createDataFrame([], SCHEMA), tokenizer("word_bpe_49k.json")).count() == 0


# ---------------------------------------------------------------- 13: threshold algorithm
def test_walk_finds_the_nearest_and_stops_early():
    rng = np.random.default_rng(1)
    for k, dims, most in ((1, 1, 3), (16, 1, 40), (7, 3, 2), (16, 64, 2), (16, 64, 100), (16, 64, 1 << 27)):
        c, x = rng.integers(-most, most, (k, dims)), rng.integers(-most, most, (300, dims))
        x[:40] = c[rng.integers(0, k, 40)]
        number, distance, measured = threshold_kmeans.Centroids(c).nearest(x)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (number == every.argmin(1)).all() and (measured <= k).all()
    line = np.arange(0, 1600, 100).reshape(-1, 1)
    assert threshold_kmeans.Centroids(line).nearest(line + 1)[2].max() <= 2


def vectors(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(40, 64)).astype(float).tolist()
    rows = [(i, v, "x", 0) for i, v in enumerate(good)] + [(0, good[1], "x", 0), (0, good[0], "x", 0), (None, good[2], None, None)]
    bad = [(90, None, "x", 1), (91, good[0][:63], "x", 1), (92, [*good[0], 0.0], "x", 1), (93, [float("nan"), *good[0][1:]], "x", 1),
           (94, [float("inf"), *good[0][1:]], "x", 1), (95, [None, *good[0][1:]], "x", 1), (96, [], "x", 1)]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)


def lloyd(rows, k=16, rounds=3):
    x = np.array([[int(np.floor(64 * e)) for e in v] for _, v, *_ in rows], object)
    order = sorted(range(len(rows)), key=lambda i: (sha(f"1:{'' if rows[i][0] is None else rows[i][0]}"), x[i].astype("<i4").tobytes()))
    c = x[order[:k]].copy()
    for step in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        own = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if step == rounds:
            return [(r[0], j, row[j]) for r, j, row in zip(rows, own, d)], [sha(",".join(map(str, w))) for w in c]
        for j in range(len(c)):
            mine = [v for v, o in zip(x, own) if o == j]
            if mine:
                c[j] = [sum(e) // len(mine) for e in zip(*mine)]


def test_clusters_of_odd_rows(spark):
    rows, table = vectors(spark)
    want, names = lloyd(rows)
    got = threshold_kmeans.report(*threshold_kmeans.cluster(table)).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    assert all(r.centroid_sha256 == names[r.cluster] and r.inertia == sum(w[2] for w in want) for r in got)
    assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)


def test_few_or_no_vectors(spark):
    rows, table = vectors(spark)
    few = threshold_kmeans.report(*threshold_kmeans.cluster(table.where("vec_id in (3, 4, 5, 91)"))).collect()
    assert sorted(r.vec_id for r in few) == [3, 4, 5] and {r.inertia for r in few} == {0}
    none = threshold_kmeans.report(*threshold_kmeans.cluster(table.where("vec_id = 91")))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_a_component_is_named(spark):
    table = spark.createDataFrame([(7, [3e7] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vector 7 has a component beyond"):
        threshold_kmeans.cluster(table)
