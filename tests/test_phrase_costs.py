import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyloom import catalog
from tallyloom.functions.dictionaries import PHRASE_STOP_WORDS
from tallyloom.operators import phrases


def plain(rows, most=15):
    """id to its rows by a plain loop; rows of one id are one document, all rows count as documents."""
    held, df = defaultdict(Counter), Counter()
    for i, text in rows:
        words = [w for w in re.sub("[^a-z0-9 ]", " ", (text or "").lower()[:2000]).split() if w not in PHRASE_STOP_WORDS]
        held[i].update(words)
        held[i].update(f"{a} {b}" for a, b in zip(words, words[1:]))
    for found in held.values():
        df.update(found.keys())
    best = {i: sorted((-round(n * math.log(len(rows) / df[p]), 6) + 0.0, p, n) for p, n in found.items())[:most] for i, found in held.items() if found}
    return {(i, place, p, n): -w for i, found in best.items() for place, (w, p, n) in enumerate(found, 1)}


@pytest.mark.parametrize(("sampled", "known"), [(10_000, 65_536), (40, 25), (10_000, 0)])
@pytest.mark.parametrize("repeated", [False, True])
def test_key_phrases_equal_a_plain_loop_whatever_is_known(spark, monkeypatch, sampled, known, repeated):
    monkeypatch.setattr(phrases, "SAMPLED", sampled)
    monkeypatch.setattr(phrases, "KNOWN", known)
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcd')}{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.choice([0, 1, 2, 20, 90]))) for _ in range(120)]
    texts += [None, "", " The of ", "same text here", "same text here", "Same, text: here!", "x1 " * 900, "one two one two one two", "all " * 20 + "same text here"]
    rows = [(i // 3 if repeated and i > 60 else None if repeated and i % 20 == 0 else i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.id, r.place, r.phrase, r.n): r.weight for r in phrases.key_phrases(frame).collect()}
    assert got == pytest.approx(plain(rows), abs=2e-6)


def test_empty_table(spark):
    assert phrases.key_phrases(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_a_row_goes_to_its_phrase_and_back_and_no_further(spark, tiny):
    """Rows of a document and phrase take part in two exchanges and no join."""
    plan = catalog.queries()["key_phrases"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_a_document_passes_on_only_its_best_known_phrases():
    found = phrases.counted(" ".join(f"w{i}" for i in range(100)) + " rare rare")
    known = {p: 10 + i for i, p in enumerate(found) if "rare" not in p}
    got = {p: (n, df) for p, n, df in phrases.leading(found, known, 1000, 15)}
    assert {p for p in got if "rare" in p} == {"rare", "w99 rare", "rare rare"} and got["rare"] == (2, None)
    assert sorted(df for _, df in got.values() if df) == list(range(10, 25))
    # All of a tie at the last place.
    assert len(list(phrases.leading(found, dict.fromkeys(known, 7), 1000, 15))) == len(found)
