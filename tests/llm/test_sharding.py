import random
import zlib

import pytest

from tallyloom.llm import sharding as S


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_whole_and_level(docs, rows, shards):
    got = S.shard(docs, shards).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by_shard = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(shards))
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_sizes_near_equal_with_a_hot_text(spark):
    rows = [(i, "same text here " * 20) for i in range(2000)] + [(5000 + i, f"text {i} " * (i % 40 + 1)) for i in range(3000)] + [(9000, "z" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sizes = [r.s for r in S.shard(docs, 10).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(sizes) == 10 and max(sizes) < 1.02 * sum(sizes) / 10


@pytest.mark.parametrize("shards, ranges", [(7, None), (7, 3), (40, 200)])
def test_groups_and_levels_equal_a_plain_count(spark, shards, ranges):
    """Copies lie in as few neighbouring shards as their bytes need, and no shard differs from the mean by more than the largest light record."""
    rng = random.Random(shards)
    texts = ["one text with very many copies " * 3] * 900 + [f"text {i} " * rng.randint(1, 30) for i in range(900) for _ in range(rng.choice([1, 1, 1, 5]))] + ["big " * 700, None, None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards, ranges=ranges).collect()
    raw = {i: (t or "").encode() for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(b) + 16, zlib.crc32(b)) for i, b in raw.items()} and len(got) == len(rows)
    filled, group, slots = [0] * shards, {}, {}
    for r in got:
        filled[r.shard] += r.size
        group.setdefault(raw[r.doc_id], []).append(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    share = sum(filled) / shards
    light = max(r.size for r in got if r.size < sum(filled) // (shards * S.HEAVY))
    assert max(abs(x - share) for x in filled) <= light + 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for text, places in group.items():
        if len(text) + 16 < sum(filled) // (shards * S.HEAVY):
            assert len(set(places)) <= (len(text) + 16) * len(places) // share + 2


def test_same_rows_same_shards(docs):
    one = {(r.doc_id, r.shard, r.slot) for r in S.shard(docs, 6).collect()}
    assert one == {(r.doc_id, r.shard, r.slot) for r in S.shard(docs.repartition(5), 6).collect()}


def test_empty_and_repeated(nothing, repeated):
    assert S.shard(nothing, 4).count() == 0
    got = S.shard(repeated, 3).collect()
    assert len(got) == 6
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_write_shards(docs, rows, tmp_path):
    path = str(tmp_path / "out")
    S.write_shards(docs.select("doc_id", "text"), path, 4)
    back = docs.sparkSession.read.parquet(path)
    assert back.count() == len(rows) and back.select("shard").distinct().count() <= 4
