import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tallyloom.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, texts):
    """A folder of tables like the driver's."""
    path = str(tmp_path_factory.mktemp("sf"))
    bench = "the benchmark asks how many rivers cross the border of the northern province in spring"
    more = ["junk junk junk " * 40, "few words", (texts[0] or "") + " " + bench + " and so on"]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate([*texts, *more])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {i: t for i, t, *_ in rows}, bench


def test_stages_one_by_one(spark, corpus, tmp_path):
    path, texts, bench = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "repeated_strings", "benchmark", "packing"]
    for k, (name, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: getattr(r, "text", None) for r in docs.collect()}
        if name == "quality":
            assert all(len(brute.blank(t)) >= 50 for t in after.values()) and all(after[i] == texts[i] for i in after)
        elif name == "near_duplicates":
            ids = sorted(before)
            groups = brute.similar_groups([before[i] for i in ids])
            assert set(after) == {ids[g] for g in groups} and all(after[i] == before[i] for i in after)
            assert len(after) < len(before)
        elif name == "repeated_strings":
            want = brute.repeated_bytes(list(before.items()))
            assert set(after) == set(before)
            assert {i: len(t.encode()) for i, t in after.items()} == {i: w[0] - w[1] for i, w in want.items()}
        elif name == "benchmark":
            assert all(brute.decontaminate(t, [(0, bench)])[1] == 0 for t in after.values())
            assert any(after[i] != before[i] for i in after)
            assert all(r.n_chars == len(r.text) for r in docs.filter("text IS NOT NULL").collect())
        else:
            assert set(after) == set(before)


def brute_run(rows, trusted, items):
    """All stages in plain Python: (doc_id, piece, start, length, ids_crc32) of each piece."""
    rows = [r for r, (_, kept) in zip(rows, brute.quality(rows, trusted)) if kept]
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, brute.signed_hash(r[1])))
    groups = brute.similar_groups([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if groups[i] == i]
    texts = brute.without_repeats(rows)
    texts = [brute.without_items(t, items) for t in texts]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for (doc_id, _), text in zip(rows, texts):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        out += [(doc_id, k, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for k, i in enumerate(range(0, len(ids), 2048))]
    return out


def test_run_equals_brute_force(spark, corpus):
    path, texts, bench = corpus
    settings = {name: spark.conf.get(name, None) for name in C.BATCH}
    got = C.run(spark, path).collect()
    assert {name: spark.conf.get(name, None) for name in C.BATCH} == settings
    want = brute_run(list(texts.items()), set(range(0, 30, 2)), [(0, bench)])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 2


RESULTS = "kept score n_bytes n_removed n_spans clean_text spans n_words n_hit items contaminated base_failed node text_hash component closure copy word new_kept first n.dots Hits".split()


def test_columns_named_like_results_pass_through(spark, corpus, tmp_path):
    path = corpus[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in RESULTS])
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, wide, path)
        assert out.dtypes == wide.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        wide = spark.read.parquet(str(tmp_path / str(k)))
        rows = wide.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in RESULTS)
    assert C.pack(spark, wide, path).count() >= len(rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, texts):
    """Null ids, rows that repeat whole or share an id only, and nulls in other columns."""
    path = str(tmp_path_factory.mktemp("odd"))
    long = [t for t in texts if t and len(t.split()) > 60][:6]
    rows = [(7, long[0]), (7, long[0]), (7, long[2]), (None, long[1]), (None, long[1]), (None, long[3] + " end"), (8, None), (None, None), (9, ""), (3, long[4] + " w" * 20_000)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_run_on_odd_rows(spark, odd):
    path, rows = odd
    got = C.run(spark, path).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((str(r[0]), *r[1:]) for r in brute_run(rows, set(), []))


def test_run_on_empty_tables(spark, odd, tmp_path):
    path = odd[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
