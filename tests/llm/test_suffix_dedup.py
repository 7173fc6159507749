import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest

from tallyloom.llm import suffix_dedup as S


def digest(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot", [1, 4096])
def test_equals_brute_force(docs, rows, hot):
    assert digest(S.dedup(docs, hot_contexts=hot)) == brute.repeated_bytes(rows)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 90))) for _ in range(4)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) + rng.choice(["", "é", "c"])) for i in range(60)]
    rows += [(60, "a" * 500), (61, "a" * 99), (62, "a" * 100), (63, "ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(S.dedup(docs, length=100, seed=32)) == brute.repeated_bytes(rows)
    assert digest(S.dedup(docs, length=41, seed=7, hot_contexts=3)) == brute.repeated_bytes(rows, 41)


@pytest.mark.parametrize("hot_rows", [0, 4096])
def test_one_line_in_all_documents(spark, hot_rows):
    """A seed of thousands of contexts, by both ways."""
    rng = random.Random(4)
    line = "this line stands at the head of every document here, whatever follows it and wherever it is from: "
    rows = [(i, line + "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 60, 140])))) for i in range(3000)]
    rows += [(5000 + i, rows[i][1][7:] + "x") for i in range(0, 3000, 50)]
    got = digest(S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), hot_rows=hot_rows))
    assert got == brute.repeated_bytes(rows)


@pytest.mark.parametrize("hot_rows, share", [(40, 1 << 17), (0, 1 << 17), (0, 16)])
def test_hot_seeds(spark, hot_rows, share):
    """All seeds above the line are found and nothing below half of it, of lines that stand 3 to 800 times."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    texts = [word(150) + line + word(150) for line in [word(100) for _ in range(6)] for _ in range(3 * 3 ** rng.randint(0, 5))]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy long").repartition(5)
    parts = docs.rdd.glom().collect()
    true, total = Counter(), 0
    for part in parts:
        known = S.Winnowed([(r.doc_id, 0, np.frombuffer(r.text.encode(), dtype=np.uint8)) for r in sorted(part)], 100, 32)
        true.update(known.g[~known.done].tolist())
        total += int((~known.done).sum())
    missed = sum(max(2, -(-n // (2 * share))) - 1 for n in [total // 5] * 5)
    line = max(hot_rows, total // share, 2 * missed)
    got = S.hot_seeds(docs, 100, 32, hot_rows, share).tolist()
    assert got == sorted(set(got)) and len(got) <= 2 * share
    assert {g for g, n in true.items() if n > line * 1.2} <= set(got) <= {g for g, n in true.items() if n > line * 0.4}
    assert S.hot_seeds(docs.limit(0), 100, 32, hot_rows, share).tolist() == []


def test_texts_under_one_id_are_told_apart(spark):
    """Texts whose hashes agree in their low 16 bits."""
    rng = random.Random(8)
    seen = {}
    while True:
        text = "".join(rng.choice("abcdefgh ") for _ in range(300))
        low = brute.xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFF
        if low in seen:
            break
        seen[low] = text
    a, b = seen[low], text
    rows = [(1, a[:150]), (9, a), (9, b)]
    got = {(r.doc_id, r.kept_sha256): r.n_removed for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in (a[:150], a[150:], b)}
    assert got == {(1, sha[a[:150]]): 0, (9, sha[a[150:]]): 150, (9, sha[b]): 0}


@pytest.mark.parametrize("hot", [1, 4096])
def test_texts_under_one_id_follow_each_other_by_start(spark, hot):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcd") for _ in range(120)) for _ in range(5)]
    rows = [(rng.choice([3, 4, None]), "".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) + str(i)) for i in range(40)]
    place = {}
    for n, (doc, text) in enumerate(rows):
        signed = (brute.xxhash.xxh64_intdigest(text.encode(), 42) ^ 1 << 63) - (1 << 63)
        for i in range(len(text) - 99):
            place.setdefault(text[i : i + 100], []).append(((doc is not None, doc), i, signed, n))
    gone = [set() for _ in rows]
    for where in place.values():
        for _, i, _, n in sorted(where)[1:]:
            gone[n].update(range(i, i + 100))
    want = sorted((str(doc), len(g), "".join(c for i, c in enumerate(t) if i not in g)) for (doc, t), g in zip(rows, gone))
    got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot_contexts=hot, hot_rows=10 * hot).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.clean_text) for r in got) == want


def test_kept_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "x" * 300, "s", 4, "a.b")], "doc_id long, text string, spans string, n_bytes int, `kept.it` string")
    row = S.dedup(docs, keep=("spans", "n_bytes", "kept.it"), prefix="new_").first()
    assert (row["spans"], row["n_bytes"], row["kept.it"], row["new_n_bytes"], row["new_n_removed"]) == ("s", 4, "a.b", 300, 299)


def test_clean_text_and_kept_columns(docs, rows):
    want = dict(rows)
    for r in S.dedup(docs, keep=("lang", "size")).collect():
        assert r.lang == "en" and r.size == 2
        if not r.n_removed:
            assert r.clean_text == want[r.doc_id]
        assert len((r.clean_text or "").encode()) <= r.n_bytes - r.n_removed


def test_empty_and_repeated(nothing, repeated):
    assert S.dedup(nothing).count() == 0
    got = S.dedup(repeated).collect()
    assert len(got) == 6
    twice = [r for r in got if r.doc_id == 7]
    assert len({(r.n_bytes, r.n_removed) for r in twice}) == 2
    assert S.cut_spans(None, None) == (0, 0, 0, hashlib.sha256(b"").hexdigest(), None)
