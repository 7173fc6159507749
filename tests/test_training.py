import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import metrics
from tallyloom.operators import training as T
from tallyloom.sources import io

TEXTS = ["what is a tree", "define Heap", "why why does it swap", "", None, "compare stack and queue", "what is it", "explain a tree", "compare tree and heap", "why not", "zzz"]
ONE = ["def", "def", "why", "why", "def", "cmp", "def", "why", "cmp", "why", "other"]
MANY = [["a"], ["a", "b"], ["b", "b"], [], None, ["c"], ["a"], ["b"], ["c", "b"], ["b", "zz"], ["c"]]
HELD = [False] * 6 + [True, False, False, True, False]


def rows(spark, multi):
    data = [(t, MANY[i] if multi else ONE[i], "test" if HELD[i] else "train") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(data, f"text string, label {'array<string>' if multi else 'string'}, fold string").repartition(3)


def dense(spark, multi, labels, buckets):
    """(X, wanted, held) of the rows that count, with numpy alone."""
    import hashlib

    xs, ys, hs = [], [], []
    for text, one, many, held in zip(TEXTS, ONE, MANY, HELD):
        if many is None if multi else one not in labels:
            continue
        words = (text or "").lower().split()
        x = np.zeros(buckets)
        for w in words:
            x[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets] += 1 / np.sqrt(len(words))
        xs.append(np.append(x, 1.0))
        ys.append([float(label in (many if multi else [one])) for label in labels])
        hs.append(held)
    return np.array(xs), np.array(ys), np.array(hs)


@pytest.mark.parametrize("multi", [False, True])
def test_every_step_equals_numpy(spark, multi):
    labels, buckets = (["a", "b", "c"] if multi else ["cmp", "def", "why"]), 32
    x, y, held = dense(spark, multi, labels, buckets)
    n = np.maximum(y[~held].sum(axis=0), 1)
    weights = ((~held).sum() - n) / n if multi else n.sum() / (len(labels) * n)
    w, mean, square, want = np.zeros((3, buckets + 1)), 0.0, 0.0, []
    for step in range(1, 9):
        z = x @ w.T
        if multi:
            p = 1 / (1 + np.exp(-z))
            loss = -(weights * y * np.log(p) + (1 - y) * np.log(1 - p)).mean(axis=1)
            slope, row_weight = (p * (1 - y) - weights * y * (1 - p)) / 3, np.ones(len(x))
            hit = ((z > 0) == (y > 0)).all(axis=1)
        else:
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            row_weight = y @ weights
            loss, slope = -row_weight * np.log((p * y).sum(axis=1)), row_weight[:, None] * (p - y)
            hit = z.argmax(axis=1) == y.argmax(axis=1)
        want.append((loss[~held].sum() / row_weight[~held].sum(), loss[held].mean(), hit[held].mean()))
        g = slope[~held].T @ x[~held] / row_weight[~held].sum()
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g**2
        w = w - 0.3 * (mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8) + 0.001 * w)
    model = T.train(rows(spark, multi), labels, io.kept, multi, buckets, steps=7, patience=99)
    assert np.allclose([(h["loss"], h["held_loss"], h["hits"]) for h in model.history], want, atol=1e-9)


def test_stops_early_and_keeps_the_best(spark):
    model = T.train(rows(spark, False), ["cmp", "def", "why"], io.kept, steps=60, every=1, patience=2)
    hits = [(h["hits"], -h["held_loss"]) for h in model.history]
    best = hits.index(max(hits))
    assert len(hits) < 61 and best == len(hits) - 3
    again = T.train(rows(spark, False), ["cmp", "def", "why"], io.kept, steps=best, every=1, patience=99)
    assert np.allclose(model.weights, again.weights)


def test_predictions(spark):
    one = T.predict(T.train(rows(spark, False), ["cmp", "def", "why"], io.kept, steps=40), rows(spark, False))
    got = {r.text: r for r in one.filter("text <> ''").collect()}
    assert one.columns == ["text", "label", "fold", "predicted", "confidence"]
    assert got["compare tree and heap"].predicted == "cmp" and got["why not"].predicted == "why" and 1 / 3 < got["why not"].confidence <= 1
    many = T.predict(T.train(rows(spark, True), ["a", "b", "c"], io.kept, multi=True, steps=40), rows(spark, True))
    assert {r.text: r.predicted for r in many.collect()}["compare tree and heap"] == ["b", "c"]
    assert T.predict(T.Model(["x"], 8, False, np.zeros((1, 9))), rows(spark, False).limit(0)).count() == 0


def test_held_out_intents(spark):
    from tallyloom import catalog

    found = catalog.queries()["intent_classifier"](spark, "/root/testdata/sf0.01")
    single = metrics.single_label(found, "intent", "predicted").first()
    assert found.count() > 300
    assert single.accuracy > 0.95 and single.macro_f1 > 0.9
    assert found.filter(F.col("confidence").between(0.2, 1.0)).count() == found.count()
