"""Models: batches from outside, held-out quality of the text classifiers, decoding and likelihoods by brute force."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftkit.operators import metrics
from siftkit.plans import model_queries as MQ
from siftkit.plans import models as MD
from siftkit.plans import queries as Q

from .conftest import SF_SMALL


def test_batches_of_an_outside_model(spark):
    rows = [(1, "eel"), (2, ""), (3, None), (4, "x" * 5000), (1, "eel")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    got = MD.score_batches(MQ.letter_scorer(7, 3, 100), df, batch_size=2)
    assert got.columns == ["id", "text", "p_pos", "p_neg"]
    want = lambda t: ((7 * len(t or "") + 3 * (t or "").count("e")) % 100 * 2 + 1) / 200
    assert sorted((r.id, r.p_pos) for r in got.collect()) == sorted((i, want(t)) for i, t in rows)
    assert all(abs(r.p_pos + r.p_neg - 1) < 1e-12 for r in got.collect())
    assert MD.score_batches(MQ.letter_scorer(7, 3, 100), df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def topics(spark):
    """Texts of three topics; some have two labels."""
    rng = np.random.default_rng(0)
    words = [[f"{t}{i}" for i in range(30)] for t in ("sea", "hill", "town")]
    rows = []
    for i in range(300):
        k = i % 3
        text = [*rng.choice(words[k], 12), *rng.choice(words[(k + 1) % 3], 4 if i // 7 % 2 else 0), *rng.choice([f"w{j}" for j in range(50)], 20)]
        rows.append((i, " ".join(text), float(k), int(k == 0 or (k == 2 and i // 7 % 2 == 1)), None if i % 10 == 0 else int(k == 1)))
    return spark.createDataFrame(rows, "doc_id long, text string, label double, sea int, hill int").repartition(3)


def test_three_classes_on_held_out_texts(topics):
    model = MD.train_text_classifier(topics.where("doc_id % 5 <> 0"), num_features=1 << 12, reg=0.01)
    s = MD.class_probs(model, topics.where("doc_id % 5 = 0")).collect()
    assert all(len(r.probs) == 3 and abs(sum(r.probs) - 1) < 1e-9 for r in s)
    assert np.mean([int(np.argmax(r.probs)) == r.label for r in s]) >= 0.95
    assert 0 < MD.iterations(model) <= 100


def test_several_labels_on_held_out_texts(topics):
    models = MD.train_label_models(topics.where("doc_id % 5 <> 0"), ["sea", "hill"], num_features=1 << 12, reg=0.01)
    scores = MD.label_scores(models, topics)
    dev, test = (scores.where(f"doc_id % 10 = {k}") for k in (5, 0))
    best = metrics.best_f1_threshold(dev, "cls", "gold", "prob", pooled=False)
    assert {r.cls for r in best.collect()} == {"sea", "hill"}
    got = {r.doc_id: r.labels for r in MD.predict_labels(test, best).collect()}
    gold = {r.doc_id: r.sea for r in topics.where("doc_id % 10 = 0").collect()}
    assert len(got) == len(gold) and np.mean([("sea" in got[k]) == bool(v) for k, v in gold.items()]) >= 0.85
    assert all(v == sorted(v) for v in got.values())


def test_held_out_quality_of_the_registered_models(spark):
    rows = Q.REGISTRY["k2_three_classes"](spark, SF_SMALL).where("held_out").collect()
    assert rows and all(r.pred in (0, 1, 2) and 0 < r.iterations <= 100 for r in rows)
    rows = Q.REGISTRY["k2_label_models"](spark, SF_SMALL).where("held_out").collect()
    assert rows and all(set(filter(None, r.labels.split("|"))) <= {"quality", "toxic"} for r in rows)  # 87 labelled texts say no more


def brute(em, trans, start):
    paths = list(itertools.product(range(len(start)), repeat=len(em)))
    value = lambda p: start[p[0]] + sum(em[i][t] for i, t in enumerate(p)) + sum(trans[a][b] for a, b in zip(p, p[1:]))
    return paths, [value(p) for p in paths]


def test_tagger_decodes_the_best_path_and_its_likelihood(spark):
    rows = [(1, ["[CLS]", "a", "b", "a"], ["[CLS]", "B", "I", "O"]), (2, ["[CLS]", "b", "b"], ["[CLS]", "O", "B"]), (3, ["[CLS]"], ["[CLS]"])]
    seqs = spark.createDataFrame(rows, "k long, tokens array<string>, tags array<string>").repartition(2)
    new = spark.createDataFrame([(*r[:2], None) for r in rows] + [(4, ["[CLS]", "c", "a"], None)], seqs.schema)
    whole, real = MD.fit_tagger(seqs, scale=MD.SCALE), MD.fit_tagger(seqs)
    assert whole.tags == ["B", "I", "O", "[CLS]"]
    got = {r.k: r.pred for r in whole.decode(new, ("k",)).collect()}
    flat = {r.k: np.reshape(r.flat, (-1, 4)) for r in whole.emission_rows(new, ("k",)).collect()}
    for k, em in flat.items():
        paths, values = brute(em, whole.matrix, whole.start)
        top = max(values)
        assert got[k] in [[whole.tags[t] for t in p] for p, v in zip(paths, values) if v == top]
        assert float(em.sum()).is_integer()
    flat = {r.k: np.reshape(r.flat, (-1, 4)) for r in real.emission_rows(seqs, ("k",)).collect()}
    for r in real.log_likelihoods(seqs, ("k",)).collect():
        paths, values = brute(flat[r.k], real.matrix, real.start)
        own = values[paths.index(tuple(real.tags.index(t) for t in rows[r.k - 1][2]))]
        assert r.score == pytest.approx(own) and r.z == pytest.approx(np.log(np.exp(values).sum()))
