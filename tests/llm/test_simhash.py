import random

import brute
import pytest

from tallyloom.llm import simhash as S
from tallyloom.llm.components import connected_components


def test_equals_brute_force(docs, rows):
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    fps = [(i, brute.fingerprint(t)) for i, t in rows]
    assert {i: f"{f:016x}" for i, f in fps} == {i: r.fingerprint for i, r in got.items()}
    assert dict(zip([i for i, _ in fps], brute.components(fps))) == {i: r.component_id for i, r in got.items()}


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_large_buckets_link_exactly(spark, limit):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)} | set(base) | {0, 2**64 - 1}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = {r.node: r.root for r in connected_components(S.fingerprint_links(spark.createDataFrame(signed, "fp long"), bucket_limit=limit)).collect()}
    want = brute.components([(f, f) for f in sorted(fps)])
    classes = {}
    for f, c in zip(sorted(fps), want):
        classes.setdefault(c, set()).add(f - (1 << 64) if f >> 63 else f)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset(n for n in roots if roots[n] == r) for r in set(roots.values())}


def test_chain_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_empty_and_repeated(nothing, repeated):
    assert S.near_duplicates(nothing).count() == 0
    got = S.near_duplicates(repeated).collect()
    assert len(got) == 6
    assert len({r.fingerprint for r in got if r.doc_id == 7}) <= 2
    assert [r.fingerprint for r in got if r.doc_id is None and r.fingerprint == "0" * 16]


def family(rng, stock, n, edits):
    """A text and copies of it with up to ``edits`` other words."""
    base = [rng.choice(stock) for _ in range(150)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit, block", [(24, 1 << 20), (3, 4000)])
def test_similar_groups_equal_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    monkeypatch.setattr(S, "BLOCK_FINGERPRINTS", 16)
    rng = random.Random(11)
    stock = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(6)) for _ in range(800)]
    texts = family(rng, stock, 60, 12) + family(rng, stock, 9, 3) + [t for _ in range(20) for t in family(rng, stock, 1, 0)]
    texts += [texts[0]] * 4 + [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b c d e f"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = {r.text_hash: r for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket_limit=limit).collect()}
    hashes = [(brute.xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 1 << 63) - (1 << 63) for t in texts]
    assert set(got) == set(hashes)
    want, least = brute.similar_groups(texts), {}
    for (i, _), h in zip(rows, hashes):
        least[h] = min(i, least.get(h, i))
    assert all(got[h].doc_id == least[h] for h in hashes)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    assert all((got[hashes[i]].component == got[hashes[j]].component) == (want[i] == want[j]) for i, j in pairs)
    # Of the texts that have a similar one, candidates miss few.
    near = [(i, j) for i, j in pairs if brute.jaccard(brute.shingles(texts[i]), brute.shingles(texts[j])) >= 0.8]
    assert sum(want[i] == want[j] for i, j in near) >= 0.95 * len(near) > 100


def test_texts_of_many_sizes_in_one_closure(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 3000)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(7)) for _ in range(700)]
    texts = [" ".join(words[:n]) for n in [*range(20, 700, 15), *range(500, 700, 7)]]
    got = {r.text_hash: r.component for r in S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [got[(brute.xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)] for t in texts]
    want = brute.similar_groups(texts)
    assert all((found[i] == found[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))
    assert 1 < len(set(want)) < len(set(texts))


def test_sets_as_similar_are_in_neighbouring_bands(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 4000)
    sizes = [0, 0, *range(1, 400, 3)]
    sets = spark.createDataFrame([(1, k, bytes(8 * n)) for k, n in enumerate(sizes)] + [(2, k, bytes(80)) for k in range(3)], "closure long, node long, shingles binary")
    layout = S._layout(sets, 0.8)
    rows = {(r.closure, r["size"]): r for r in layout.collect()}
    assert [(r.band, r.blocks) for k, r in rows.items() if k[0] == 2] == [(-1, 1)]
    classes = {r.node: r["size"] for r in sets.filter("closure = 1").select("node", S._size_class(0.8).alias("size")).collect()}
    assert all(abs(classes[i] - classes[j]) <= 1 for i, a in enumerate(sizes) for j, b in enumerate(sizes) if a and b and min(a, b) >= 0.8 * max(a, b))
    blocks = [(r.band, i) for (c, _), r in rows.items() if c == 1 for i in range(r.blocks)]
    want = sorted((*x, *y) for x in blocks for y in blocks if x < y and y[0] - x[0] <= 1)
    assert sorted((r.p, r.i, r.q, r.j) for r in S._block_pairs(layout).collect()) == want
    assert len(want) < len(blocks) * (len(blocks) - 1) / 4


@pytest.mark.parametrize("distance", [3, 4])
def test_wide_links_of_large_keys(spark, distance):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(60)})
    signed = [((f ^ 1 << 63) - (1 << 63),) for f in fps]
    links = S.fingerprint_links(spark.createDataFrame(signed, "fp long"), distance, blocks=distance + 2, bucket_limit=5)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    want = brute.components([(f, f) for f in fps], distance)
    got = [roots.get(f, f) for (f,) in signed]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_words_that_a_short_checksum_confuses_are_apart(spark):
    one, two = (" ".join([*(f"w{i}" for i in range(20)), word, *(f"v{i}" for i in range(20))]) for word in ("hhtscvbpu", "jnwusqgpc"))
    assert len(set(S.shingle_set(one)) & set(S.shingle_set(two))) == 32
    assert not set(S.shingle_set("hhtscvbpu")) & set(S.shingle_set("jnwusqgpc"))
    rows = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert len({r.component for r in S.similar_groups(rows).collect()}) == 2


def test_similar_groups_of_nothing(nothing, repeated):
    assert S.similar_groups(nothing).count() == 0
    assert len({r.component for r in S.similar_groups(repeated).collect()}) in (3, 4)


def test_blocks_follow_the_number_of_fingerprints():
    assert [S.blocks_for(n, 6) for n in (0, 10**5, 10**8, 10**10, 10**12)] == [8, 8, 8, 9, 11]
    assert S.blocks_for(10**18, 6) == 12
