"""Ordinal regression against independent formulas: likelihood, gradients, thresholds, grades and the fit itself."""

import math
import random

import numpy as np
import pytest

from riskframes.llm import ordinal


def sample(seed=0, rows=60, columns=12):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 6, rows)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    column = np.concatenate([r.choice(columns, n, replace=False) for n in sizes])
    value = r.uniform(0.2, 2, len(column))
    grades = r.integers(0, 3, rows)
    return edges, column, value, grades


def brute_loss(w, gaps, edges, column, value, grades):
    theta = [gaps[0]]
    for g in gaps[1:]:
        theta.append(theta[-1] + math.exp(g))
    total = 0.0
    for i, k in enumerate(grades):
        s = sum(w[column[j]] * value[j] for j in range(edges[i], edges[i + 1]))
        below = lambda t, s=s: 1 / (1 + math.exp(s - t))
        up = below(theta[k]) if k < len(theta) else 1.0
        down = below(theta[k - 1]) if k else 0.0
        total -= math.log(up - down)
    return total / len(grades)


def test_likelihood_and_gradients():
    edges, column, value, grades = sample()
    r = np.random.default_rng(1)
    w, gaps = r.normal(0, 0.5, 12), np.array([-0.4, 0.3])
    loss, g, gg = ordinal.objective(w, gaps, edges, column, value, grades)
    assert loss == pytest.approx(brute_loss(w, gaps, edges, column, value, grades))
    step = 1e-6
    for k in range(12):
        d = np.zeros(12)
        d[k] = step
        slope = (brute_loss(w + d, gaps, edges, column, value, grades) - brute_loss(w - d, gaps, edges, column, value, grades)) / (2 * step)
        assert g[k] == pytest.approx(slope, abs=1e-7)
    for k in range(2):
        d = np.zeros(2)
        d[k] = step
        slope = (brute_loss(w, gaps + d, edges, column, value, grades) - brute_loss(w, gaps - d, edges, column, value, grades)) / (2 * step)
        assert gg[k] == pytest.approx(slope, abs=1e-7)


def test_fit_is_near_the_optimum():
    """No move from the fitted point lowers the penalised loss by more than a little: it is convex in weights and thresholds."""
    edges, column, value, grades = sample(2, rows=200, columns=8)
    l1 = 3e-4
    model = ordinal.fit(edges, column, value, grades, 2, steps=3000, l1=l1)
    w, theta = model.weights[:8], model.thresholds
    gaps = np.array([theta[0], math.log(theta[1] - theta[0])])
    at = lambda w, gaps: brute_loss(w, gaps, edges, column, value, grades) + l1 * np.abs(w).sum()
    best = at(w, gaps)
    r = np.random.default_rng(3)
    for _ in range(200):
        size = 10 ** r.uniform(-3, 0)
        assert at(w + size * r.normal(0, 1, 8), gaps + size * r.normal(0, 1, 2)) > best - 1e-4


def test_grades_are_brute_force(spark):
    """Expected grade and tail probability of whole texts, by a plain reading of the features."""
    r = random.Random(4)
    texts = [" ".join(r.choice(["good", "bad!", "Wörd", "x1", "loooooong"]) for _ in range(r.randint(0, 40))) for _ in range(40)] + [None, "", " \n "]
    rng = np.random.default_rng(5)
    model = ordinal.Model(rng.normal(0, 0.2, ordinal.BUCKETS), np.array([-0.5, 0.7]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x for x in ordinal.grade(df, model).collect()}
    for k, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, bucket, value = ordinal.features(data, np.array([0, len(data)]))  # alone, so that neighbours can't leak in
        s = sum(model.weights[b] * v for b, v in zip(bucket, value, strict=True))
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert got[k]["expected_grade"] == pytest.approx(sum(above)) and got[k]["top_probability"] == pytest.approx(above[1])
        assert got[k]["kept"] == (got[k]["top_probability"] >= 0.5)


def test_words_are_features():
    """Words count once, in any case; a word more is a bucket more."""
    read = lambda t: ordinal.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1:]
    ones = lambda t: {b for b, v in zip(*read(t), strict=True) if v == 1.0}
    assert len(ones(b"Good good GOOD bad x y") & ones(b"good bad x y")) >= 4
    assert len(ones(b"alpha beta gamma delta") - ones(b"alpha beta gamma")) >= 1
    shapes = sorted(v for v in read(b"ab cd Ef g1")[1] if v != 1.0)
    assert shapes == pytest.approx([2.0])  # two of four words are small letters alone; 4 * 2 / 4


def test_lowest_grade_and_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in ordinal.graded(labels).collect()} == {1: 1, 2: 0}
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (2, "c d", "x", "y")], "doc_id long, text string, grade string, k string")
    model = ordinal.fit_on(docs, labels)
    assert ordinal.grade(docs, model).columns == ["doc_id", "expected_grade", "top_probability", "kept"]
