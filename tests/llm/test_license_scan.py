import random

import brute
import pytest

from tallyloom.llm import license_scan as L


def test_base_equals_brute_force(docs, rows):
    got = {r.doc_id: r for r in L.license_scan(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(text, L.BASE_PHRASES)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_notice_with_a_dropped_word_lies_on_two_diagonals(spark):
    text = "you can redistribute it modify it under the terms of the gnu general public license today"
    row = L.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert "gpl-header" in row.labels.split(",") and 0.75 <= row.score <= 1
    assert row.base_labels == "gpl" and row.n_base == 1 and row.first_word == 12


def test_notices_equal_a_brute_force_vote(spark):
    rng = random.Random(6)
    stock = "the of and license software this is in to under terms rights reserved all licensed use".split()
    texts = []
    for phrase in L.NOTICES:
        words = phrase.split()
        for _ in range(6):
            own = [w for w in words if rng.random() > 0.04]
            for _ in range(rng.randint(0, 3)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(stock))
            texts.append(" ".join([*rng.choices(stock, k=5), *own, *rng.choices(stock, k=9), *own[len(own) // 2 :]]))
    texts += [" ".join(rng.choices(stock, k=200)) for _ in range(10)] + ["all rights all rights", "rights reserved all rights", "licensed under " * 6, "all rights reserved"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, text in rows:
        labels, share = brute.license_notices(text, L.NOTICES)
        base = set(brute.license_base(text, L.BASE_PHRASES)[4].split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == labels | base
        assert got[i].score == pytest.approx(1.0 if base else share)
        assert all(s.last - s.first + 1 <= 170 for s in got[i].spans) and {s.label for s in got[i].spans} == labels
    assert [got[i].labels for i, t in rows[-4:]] == ["", "", "", "all-rights-reserved"]
    assert [tuple(s) for s in got[len(rows) - 1].spans] == [(0, 2, "all-rights-reserved", 1.0)]


def test_overlapping_places_count(spark):
    row = L.license_scan(spark.createDataFrame([(1, "MIT license mit LICENSE.mit-license")], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word) == (3, 0, 4)


def test_empty_and_repeated(nothing, repeated):
    assert L.license_scan(nothing).count() == 0
    got = L.license_scan(repeated).collect()
    assert len(got) == 6
    assert {r.n_base for r in got if r.doc_id == 8} == {1}
    assert all(r.n_base == 0 for r in got if r.doc_id != 8)


def test_no_python_in_the_plan(docs):
    plan = L.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
