import random
import zlib

import numpy as np
import pytest

from meterql.llm import quality_mil as mil
from tests.llm.helpers import docs


def made(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "tree", "grows", "over", "hills,", "and", "rivers.", "Many"]
    texts, labels = [], []
    for _ in range(n):
        text = [rng.choice(words) + rng.choice(["", "s"]) for _ in range(rng.randrange(5, 400))]
        good = rng.random() < 0.7
        if not good:  # one passage of junk is enough
            at = rng.randrange(len(text))
            text[at:at] = ["CLICK!!", "###"] * 40
        texts.append(" ".join(text))
        labels.append(int(good))
    return texts, labels


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x, bags, y = rng.normal(size=(9, mil.N_FEATURES)), np.array([2, 1, 4, 2]), np.array([0.0, 1, 1, 0])
    model = mil.Model()
    model.p["c"] = rng.normal(size=mil.HIDDEN)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    z = (x - model.mean) / model.scale
    loss = lambda: -np.mean(np.log(np.where(y == 1, model._forward(z, bags)[-1], 1 - model._forward(z, bags)[-1])))
    before = {k: v.copy() for k, v in model.p.items()}
    for name in model.p:
        model.p = {k: v.copy() for k, v in before.items()}
        flat = model.p[name].reshape(-1)
        flat[0] += 1e-5
        up = loss()
        flat[0] -= 2e-5
        slope = (up - loss()) / 2e-5
        model.p = {k: v.copy() for k, v in before.items()}
        model.fit(x, bags, y, steps=1)  # Adam's first step has the gradient's sign
        moved = (model.p[name] - before[name]).reshape(-1)[0]
        assert abs(slope) < 1e-6 or np.sign(moved) == -np.sign(slope)


def test_a_text_scores_alike_beside_any_others():
    texts = ["\n\n lead", "one two", None, "", "B. " * 300, "one two"]
    model = mil.Model()
    model.p["c"] += 0.5
    alone = [model.score([t])[0] for t in texts]
    assert model.score(texts) == pytest.approx(alone, abs=1e-12) and model.score(texts[::-1]) == pytest.approx(alone[::-1], abs=1e-12)
    assert sum(mil.featurise(texts)[1]) == 1 + 1 + 1 + 1 + 5 + 1


def test_held_out_accuracy(spark):
    texts, labels = made()
    frame = docs(spark, texts, extra=["score", "label", "key"])
    marks = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = mil.scores(frame, mil.train(frame, marks)).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_passages_of_long_documents_all_train(spark):
    frame = docs(spark, ["word " * 64 * 200, "a b"], [1, 2])
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit = mil.Model.fit
    mil.Model.fit = lambda self, x, bags, labels, **k: seen.append(sorted(bags.tolist())) or fit(self, x, bags, labels, **k)
    try:
        mil.train(frame, marks)
    finally:
        mil.Model.fit = fit
    assert seen == [[1, 200]]


def test_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    rows = mil.scores(docs(spark, ["a", "b"], [big, None]), mil.Model()).collect()
    assert sorted((r.doc_id or 0, r.held_out) for r in rows) == [(0, True), (big, zlib.crc32(str(big).encode()) % 5 == 0)]


def test_a_doc_id_of_many_rows_trains_as_one(spark):
    texts, labels = made(30)
    marks = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    once = mil.train(docs(spark, texts), marks)
    often = mil.train(docs(spark, texts + [texts[1]] * 50, [*range(30), *[1] * 50]), marks)
    assert once.score(texts) == pytest.approx(often.score(texts))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = docs(spark, [None, "", "a", "a"], [0, 1, 2, 2])
    assert [r.score for r in mil.scores(frame, mil.train(frame, none)).collect()] == [0.5] * 4
    assert mil.scores(docs(spark, []), mil.Model()).collect() == []
