import hashlib
import random
import zlib

import brute
import pytest

from tallyloom.llm import manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[i : i + 8]) for i in range(0, len(row), 8)])
    return levels


def path(levels, i):
    out = []
    for row in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(row[a:i]), "".join(row[i + 1 : a + 8])))
        i //= 8
    return out


def expected(rows):
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def leaf(*values):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    groups = {}
    for doc_id, source, lang, n, text in rows:
        old = new = leaf(doc_id, source, lang, n, text)
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            new = leaf(doc_id, source, lang, n, text and text.translate(brute.LOWER))
        groups.setdefault(lang, []).append((doc_id is None, doc_id or 0, old, new, doc_id))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = [build([m[2] for m in sorted(groups[k], key=lambda m: m[:3])]) for k in names]
    top = build([t[-1][0] for t in trees])
    out = []
    for g, k in enumerate(names):
        for i, (_, _, old, new, doc_id) in enumerate(sorted(groups[k], key=lambda m: m[:3])):
            steps = path(trees[g], i) + path(top, g)
            for b, a in steps:
                new = H(b, new, a)
            out.append((doc_id, old, trees[g][-1][0], top[-1][0], H(*[b + a for b, a in steps]), new, new == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, size int, at string, `grp` string"


def made(n, langs, seed=2):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(i, rng.choice(["web", None, ""]), rng.choice(langs), rng.choice([None, 5]), rng.choice(["Ab É", "abc", None, "", "XYZ " * 50])) for i in ids]


def wide(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


def key(r):
    return str(r)


@pytest.mark.parametrize("n, langs, levels", [(700, ["en"], 1), (300, ["en", None, "", "é", "z", "fr"], 1), (600, ["en", "en", "en", "de"], 3), (65, ["a"], 2), (1, ["en"], 3), (9, ["en", "de"], 3), (40, [f"l{i}" for i in range(30)], 1)])
def test_equals_plain_trees(spark, n, langs, levels):
    rows = made(n, langs)
    got = [tuple(r) for r in M.manifest(wide(spark, rows), levels=levels).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_repeated_rows_and_null_ids(spark):
    rows = made(20, ["en", None]) + [(5, "s", "en", 1, "Ab")] * 12 + [(5, "s", "en", 1, "Other")] + [(None, None, None, None, None)] * 3 + [(None, "s", "en", 2, "ABC")]
    got = [tuple(r) for r in M.manifest(wide(spark, rows), levels=1).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_empty_and_kept(spark):
    rows = wide(spark, made(30, ["en", "de"]))
    assert M.manifest(rows.limit(0)).count() == 0
    kept = M.manifest(rows, keep=("size", "at", "grp"), prefix="new_")
    assert kept.columns == ["doc_id", "new_leaf", "new_subroot", "new_root", "new_proof_sha256", "new_folded_root", "new_verified", "size", "at", "grp"]
    assert {(r.size, r.at, r.grp) for r in kept.collect()} == {(1, "x", "y")}


@pytest.mark.parametrize("n, levels", [(1, 0), (1, 2), (8, 1), (9, 2), (65, 3), (200, 3)])
def test_versions_share_all_but_a_path(n, levels):
    leaves = [H(str(i)) for i in range(n)]
    tree = M.PathTree(leaves, levels)
    top = tree.digests[tree.base]
    for leaf in {0, n // 2, n - 1}:
        size = len(tree.digests)
        version = tree.tampered(leaf, H("new"))
        assert len(tree.digests) == size + levels + 1
        plain = list(leaves)
        plain[leaf] = H("new")
        other = M.PathTree(plain, levels)
        assert tree.digests[version] == other.digests[other.base]
        assert tree.digests[tree.base] == top
        old, new = tree.path(leaf, tree.base), tree.path(leaf, version)
        for (a, at), (b, bt) in zip(old, new):
            assert at == bt and a != b
            assert [c for i, c in enumerate(tree.children[a]) if i != at] == [c for i, c in enumerate(tree.children[b]) if i != at]
        assert tree.siblings(leaf) == tree.siblings(leaf, version)
        assert M.fold(H("new"), tree.siblings(leaf)) == tree.digests[version]


def test_versions_of_versions():
    leaves = [H(str(i)) for i in range(100)]
    tree = M.PathTree(leaves, 3)
    both = tree.tampered(70, H("b"), tree.tampered(3, H("a")))
    leaves[3], leaves[70] = H("a"), H("b")
    assert tree.digests[both] == build(leaves)[-1][0]
