import pickle

import brute
import numpy as np
import pytest

from tallyloom.llm import decontamination as D

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item, here!"), (3, None), (4, " .. "), (2, "another TEXT of two"), (5, "one two three four five six seven eight nine ten")]
TEXTS = [
    (1, "x Alpha beta-gamma delta epsilon zeta eta theta iota kappa y"),
    (2, "short ITEM here short item here and another text of two"),
    (3, None),
    (4, ""),
    (5, "nothing to see"),
    (6, "one two three four five six seven eight nine"),
    (7, "zero one two three four five six seven eight nine ten alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"),
]
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("max_words", [10**6, 0])
def test_equals_brute_force(spark, max_words):
    docs, bench = spark.createDataFrame(TEXTS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in D.scan(docs, bench, max_words=max_words).collect()}
    for doc_id, text in TEXTS:
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.decontaminate(text, ITEMS)


def test_both_ways_agree(docs, rows, spark):
    bench = spark.createDataFrame([(i, t[:300]) for i, t in rows[:9] if t], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans"]
    one = {tuple(map(str, r)) for r in D.scan(docs, bench).select(columns).collect()}
    assert one == {tuple(map(str, r)) for r in D.scan(docs, bench, max_words=0).select(columns).collect()}


def test_the_set_is_small_and_flat():
    rng = np.random.default_rng(3)
    words = [b"w%07x" % i for i in rng.integers(0, 1 << 28, 200_000)]
    table = D.WindowSet(((str(i), words[i : i + 50]) for i in range(0, len(words), 50)), 10)
    assert table.nbytes < 100 * len(words) and len(pickle.dumps(table)) < 100 * len(words)
    short = D.WindowSet(((str(i), words[i : i + 1]) for i in range(len(words))), 10)
    assert short.nbytes < 100 * len(words)
    places, items = table.hits([b"x", *words[100:115], b"x", *words[110:118]])
    assert (places, items) == ([(i, 10) for i in range(1, 7)], ["100"])


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "_rolled", lambda ids, size: np.zeros(len(ids) - size + 1, dtype=np.uint64))
    items = [("a", b"one two three".split()), ("b", b"four five six".split()), ("c", b"one two three".split()), (None, b"six five four".split())]
    table = D.WindowSet(items, 3)
    assert table.hits(b"one two three four five six".split()) == ([(0, 3), (3, 3)], ["a", "b", "c"])
    assert table.hits(b"two three four".split()) == ([], [])
    assert table.hits(b"six five four".split()) == ([(0, 3)], [])


@pytest.mark.parametrize("bounds", [{}, {"max_bytes": 1000}, {"max_words": 0}])
def test_a_window_of_very_many_items_and_documents(spark, bounds):
    hot = "one two three four five six seven eight nine ten"
    items = [(i, hot) for i in range(300)] + [(300, "eleven twelve")]
    docs = spark.createDataFrame([(i, f"{hot} and {hot} x{i}") for i in range(200)] + [(200, "eleven twelve")], SCHEMA)
    got = D.scan(docs, spark.createDataFrame(items, "item_id long, text string"), **bounds)
    counts = {(r.n_hit, r.n_items): r["count"] for r in got.groupBy("n_hit", "n_items").count().collect()}
    assert counts == {(20, 300): 200, (2, 1): 1}


def test_spans_go_and_the_rest_stays(spark):
    docs = spark.createDataFrame([(1, "É bon: (one two three four five six seven eight nine ten) fin"), (2, "clean text")], SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.clean_text for r in D.scan(docs, bench, remove_spans=True).collect()}
    assert got == {1: "É bon: () fin", 2: "clean text"}


def test_empty_and_repeated(spark, nothing, repeated):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.scan(nothing, bench).count() == 0
    assert D.scan(repeated, bench).count() == 6
    none = spark.createDataFrame([], "item_id long, text string")
    for limit in (10**6, -1):
        assert not any(r.contaminated for r in D.scan(repeated, none, max_words=limit).collect())


@pytest.mark.parametrize("max_words", [10**6, 0])
def test_ids_that_are_null_or_hold_commas(spark, max_words):
    items = [("x,y", "one two three four five six seven eight nine ten"), (None, "alpha beta gamma"), ("z", "gamma delta")]
    texts = [(1, "zero one two three four five six seven eight nine ten"), (2, "alpha beta gamma delta"), (3, "alpha beta gamma"), (None, "gamma delta"), (None, "gamma")]
    docs, bench = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.n_words): r for r in D.scan(docs, bench, max_words=max_words).collect()}
    assert {k: (r.n_hit, r.n_items, r["items"], r.contaminated) for k, r in got.items()} == {(1, 11): (10, 1, "x,y", True), (2, 4): (4, 1, "z", True), (3, 3): (3, 0, "", True), (None, 2): (2, 1, "z", True), (None, 1): (0, 0, "", False)}
    assert got[3, 3].items_sha256 == brute.hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("max_words", [10**6, 0])
def test_kept_columns_named_like_results(spark, max_words):
    docs = spark.createDataFrame([(1, "short item here", "h", "a.b", 5)], "doc_id long, text string, hits string, `n.hit` string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = D.scan(docs, bench, max_words=max_words, keep=("hits", "n.hit", "n_hit"), prefix="new_", remove_spans=True).first()
    assert (row["hits"], row["n.hit"], row["n_hit"], row["new_n_hit"], row["new_clean_text"]) == ("h", "a.b", 5, 3, "")
