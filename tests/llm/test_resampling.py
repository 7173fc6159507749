import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash

from tallyloom.llm import resampling as R


def features(text):
    w = brute.alnum(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(docs, target, percent=5, min_words=20):
    """{(doc_id, text): (n_features, weight, score)} and the drawn ids in order, by plain counting."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in docs], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000))))
    rows = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, text, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = [r for r in rows if len(brute.alnum(r[1])) >= min_words]
    order = sorted(able, key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return {(r[0], r[1]): r[2:] for r in rows}, [r[0] for r in order[: percent * len(able) // 100]]


def test_hashes_equal_the_libraries():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts = rng.integers(0, 3800, 3000)
    lengths = rng.choice([*range(0, 80), 200], 3000)
    lengths[:400] = np.repeat([31, 32, 33, 63], 100)
    table = R.NgramTable(data, starts, lengths)
    raw = [data[s : s + m].tobytes() for s, m in zip(starts, lengths)]
    assert table.keys.tolist() == [xxhash.xxh64_intdigest(x) for x in raw]
    assert [table.bucket[s] for s in table.slot] == [zlib.crc32(x) % 10_000 for x in raw]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_slots_hold_equal_bytes_even_if_keys_collide(bits):
    rng = np.random.default_rng(bits)
    data = rng.integers(97, 99, 600, dtype=np.uint8)
    starts, lengths = rng.integers(0, 500, 700), rng.integers(1, 12, 700)
    lengths[:40] = 90
    starts[:40] = rng.choice([3, 300], 40)
    raw = [data[s : s + m].tobytes() for s, m in zip(starts, lengths)]
    keys = np.array([xxhash.xxh64_intdigest(x) & ((1 << bits) - 1) for x in raw], dtype=np.uint64)
    table = R.NgramTable(data, starts, lengths, keys=keys)
    slots = {}
    for x, s in zip(raw, table.slot.tolist()):
        assert slots.setdefault(x, s) == s
    assert len(set(slots.values())) == len(slots) == len(table.used)
    assert {x: table.count[s] for x, s in slots.items()} == Counter(raw)


def test_words_of_a_batch():
    texts = [b"Ab-c", None, b"", b" \xc3\xa9t\xc3\xa9 1", b"x"]
    w = R.Words(texts)
    got = [[bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(a, b)] for a, b in zip(w.bounds, w.bounds[1:])]
    assert got == [["ab", "c"], [], [], ["été", "1"], ["x"]]
    assert R.Words([]).bounds.tolist() == [0] and len(R.Words([None, b"-"]).starts) == 0


@pytest.mark.parametrize("run_words", [100_000, 7])
def test_runs_lose_no_ngram(texts, run_words, monkeypatch):
    monkeypatch.setattr(R, "RUN_WORDS", run_words)
    some = [t.encode() if t else None for t in texts if t is None or len(t) < 3000]
    total = np.zeros(R.BUCKETS, dtype=np.int64)
    for _, table in R._runs(R.Words(some), 3, R.BUCKETS):
        np.add.at(total, table.bucket[table.used], table.count[table.used])
    want = Counter(zlib.crc32(f.encode()) % R.BUCKETS for t in some for f in features(t.decode() if t else ""))
    assert {b: n for b, n in enumerate(total.tolist()) if n} == want


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_equals_brute_force(spark, docs, rows, percent):
    items = [t[:400] for _, t in rows[:6] if t] + [None, ""]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    want, drawn = expected(rows, items, percent)
    got = R.resample(docs, target, percent=percent).collect()
    text_of = dict(rows)
    assert {(r.doc_id, text_of[r.doc_id]): (r.n_features, r.weight, r.score) for r in got} == want and len(got) == len(rows)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_repeated_kept_and_empty(spark, docs, nothing, repeated):
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    none = target.limit(0)
    assert R.resample(nothing, target).count() == 0
    got = R.resample(repeated, target, percent=100).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    same = [r for r in got if r.doc_id == 7 and r.n_words == 56]
    assert len({r.score for r in same}) == 1 and abs(same[0]["rank"] - same[1]["rank"]) == 1
    assert all(r.weight <= 0 or r.n_features for r in R.resample(repeated, none).collect())
    kept = R.resample(docs, target, keep=("score", "words", "text"), prefix="new_")
    assert kept.columns == ["doc_id", "new_n_words", "new_n_features", "new_weight", "new_score", "new_rank", "score", "words", "text"]
    assert {r.score for r in kept.collect()} == {0.5}
