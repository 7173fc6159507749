import random

import pytest

from tallyloom.operators import matching as M


@pytest.mark.parametrize("gram", [1, 2, 6])
def test_containment_equals_a_nested_loop(spark, gram, monkeypatch):
    monkeypatch.setattr(M, "GRAM", gram)
    rng = random.Random(gram)
    make = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(i, make(rng.randint(0, 25))) for i in range(60)] + [(100, None), (101, "what is a tree"), (102, "É" * 7 + "tree")]
    parts = [(i, make(rng.randint(1, 9))) for i in range(40)] + [(50, "tree"), (51, "what is a tree"), (52, "nowhere to be seen"), (53, "É" * 6)]
    got = M.containment(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(parts, "part_id int, part string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, t in texts for j, p in parts if t is not None and p in t)


def test_containment_of_nothing(spark):
    none = spark.createDataFrame([], "text_id long, text string")
    parts = spark.createDataFrame([(1, "x")], "part_id int, part string")
    assert M.containment(none, parts).count() == 0
    empty = M.containment(spark.createDataFrame([(1, "x")], "text_id long, text string"), parts.limit(0))
    assert empty.columns == ["text_id", "part_id"] and empty.count() == 0


def plain_match(question, bank, least=0.18):
    """(pos, how) by trying every pattern."""
    from tallyloom.functions import dictionaries as D

    fold = lambda s: " ".join("".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in s.lower()).split())
    words = lambda s: {D.BANK_SYNONYMS.get(w, w) for w in set(s.split()) - set(D.BANK_STOP_WORDS)}
    q = fold(question)
    rows = [(pos, fold(p)) for pos, p in bank]
    equal = [pos for pos, p in rows if p == q]
    if equal:
        return min(equal), "equal"
    inside = [(-len(p.split()), pos) for pos, p in rows if p and (p in q or q in p)]
    if inside:
        return min(inside)[1], "contains"
    qw, scored = words(q), []
    for pos, p in rows:
        pw = words(p)
        o = len(qw & pw)
        score = min(1, len(pw) / 6) * 0.3
        if o:
            score += o / len(qw | pw) * 0.7 + o * 0.1 + (0.25 if qw & set(D.BANK_BOOST_WORDS) else 0)
        scored.append((-round(score, 9), pos))
    best = min(scored, default=(0, None))
    return (best[1], "words") if -best[0] > least else (None, "none")


def test_bank_match_equals_trying_every_pattern(spark):
    rng = random.Random(4)
    stock = ["what", "is", "a", "tree", "greedy", "stack", "os", "tcp", "Explain", "process?", "thread", "hash", "join", "the"]
    make = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    bank = [(i * 2, make(rng.randint(1, 7))) for i in range(40)] + [(99, "?!"), (100, "what is a")]
    asked = [(i, make(rng.randint(0, 9))) for i in range(150)] + [(900, "..."), (901, "zzz"), (902, "What is a TREE"), (903, "What is a TREE")]
    got = M.bank_match(spark.createDataFrame(asked, "question_id long, text string"), spark.createDataFrame(bank, "pos long, pattern string"))
    assert {r.question_id: (r.pos, r.how) for r in got.collect()} == {i: plain_match(t, bank) for i, t in asked}


def test_bank_match_without_bank_or_text(spark):
    asked = spark.createDataFrame([(1, "what is a tree"), (2, None)], "question_id long, text string")
    bank = spark.createDataFrame([(7, "tree")], "pos long, pattern string")
    assert {tuple(r) for r in M.bank_match(asked, bank.limit(0)).collect()} == {(1, None, "none", None), (2, None, "none", None)}
    assert {(r.question_id, r.how) for r in M.bank_match(asked, bank).collect()} == {(1, "contains"), (2, "none")}


def test_no_join_without_an_equal_key(spark, tiny):
    from tallyloom import catalog

    plan = catalog.queries()["bank_match"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan


def test_answers_are_not_lost_where_ids_have_gaps(spark, tiny, tmp_path):
    from tallyloom.plans import tables

    kept = spark.read.parquet(f"{tiny}/benchmark.parquet").filter("item_id % 3 <> 1")
    kept.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{tiny}/conversations.parquet").write.parquet(str(tmp_path / "conversations.parquet"))
    graded = tables.graded_answers(spark, str(tmp_path))
    assert graded.count() == tables.answers(spark, str(tmp_path)).count()
    assert {r.slot for r in graded.collect()} <= {r.item_id for r in kept.collect()}
