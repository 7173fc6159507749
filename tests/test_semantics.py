import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import grading, semantics
from tallyloom.sources import io

STOCK = ["tree", "heap", "stack", "queue", "tcp", "udp", "packet", "route", "sql", "join", "index", "table", "thread", "lock"]
TOPICS = [STOCK[:4], STOCK[4:8], STOCK[8:12], STOCK[12:]]


def made(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(rng.choice(TOPICS[i % 4 : i % 4 + 1] * 5 + TOPICS)) for _ in range(rng.randint(1, 12))) for i in range(n)] + ["", None, "  ", "Tree TREE heap"]


def tfidf(texts, buckets):
    """Dense unit rows by plain Python."""
    b = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets
    bags = [[b(w) for w in (t or "").lower().split()] for t in texts]
    df = np.zeros(buckets)
    for bag in bags:
        for x in set(bag):
            df[x] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    x = np.array([np.bincount(bag, minlength=buckets) * idf if bag else np.zeros(buckets) for bag in bags])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


@pytest.mark.parametrize("size", [3, 14, 64])
def test_equals_a_dense_factorisation(spark, size):
    texts, buckets = made(120), 64
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    model = semantics.fit(rows, io.kept, size=size, buckets=buckets, rounds=30)
    x = tfidf(texts, buckets)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    rank = min(size, int((s > 1e-6).sum()))
    assert np.allclose(model.weights[:rank], s[:rank], atol=1e-6) and not model.weights[rank:].any()
    v = x @ vt[:rank].T
    v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    got = {r.i: np.array(r.vector) for r in semantics.embed(model, rows).collect()}
    mine = np.array([got[i] for i in range(len(texts))])
    assert np.allclose(mine @ mine.T, v @ v.T, atol=1e-5)
    assert not mine[-4:-1].any()


def test_similarity_and_targets(spark):
    rows = spark.createDataFrame([(1, "tree heap", "heap tree"), (2, "tcp udp", "sql join"), (3, None, "tree"), (4, "zzz", "yyy")], "i int, text string, other string")
    model = semantics.fit(spark.createDataFrame([(t,) for t in made(200)], "text string"), io.kept, size=8, buckets=256)
    got = {r.i: r.similarity for r in semantics.similarity(model, rows, "text", "other").collect()}
    assert got[1] == pytest.approx(1) and got[2] < 0.6 and got[3] == 0 and got[4] == pytest.approx(0, abs=1)
    targets = spark.createDataFrame([("b", "packet route tcp"), ("a", "heap stack tree"), ("c", "index join")], "target string, text string")
    found = {r.i: r for r in semantics.best_targets(model, rows, targets).collect()}
    assert (found[1].target, found[2].target, found[3].target, found[3].cosine) == ("a", "b", "a", 0.0) and found[1].cosine > 0.5
    assert {r.target for r in semantics.best_targets(model, rows, targets.limit(0)).collect()} == {None}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "text string")
    model = semantics.fit(none, io.kept, size=4, buckets=32)
    assert not model.weights.any()
    rows = spark.createDataFrame([("tree",)], "text string")
    assert not any(semantics.embed(model, rows).first().vector)


def test_queries_on_text(spark, tiny):
    from tallyloom import catalog

    graded = catalog.queries()["semantic_grade"](spark, tiny)
    assert graded.filter((F.col("similarity") > 1.0001) | (F.col("similarity") < -1.0001) | F.col("similarity").isNull()).count() == 0
    matched = catalog.queries()["domain_match"](spark, tiny)
    assert matched.count() == 200 and matched.filter("item_id is null").count() == 0


def test_grader_learns_its_labels(spark):
    from tallyloom import catalog

    rows = catalog.queries()["meta_grader"](spark, "/root/testdata/sf0.01")
    error = rows.agg(F.avg(F.abs(F.col("label") - F.col("predicted"))), F.min("predicted"), F.max("predicted"), F.count("*")).first()
    assert error[0] < 0.03 and error[1] >= 0 and error[2] <= 1 and error[3] > 1000


def test_grader_with_missing_values(spark):
    rows = spark.createDataFrame([(float(i % 7) / 7, i % 3, 0.5 if i % 5 else None) for i in range(300)] + [(None, 1, 0.1)], "a double, b int, label double")
    model = grading.train_grader(rows, ["a", "b"])
    got = grading.grade(model, rows)
    assert got.columns == ["a", "b", "label", "predicted"] and dict(got.dtypes)["b"] == "int"
    assert got.filter("predicted is null").count() == 1
