import pytest
from pyspark.sql import functions as F

from tallyloom.operators import profiles
from tallyloom.sources import snapshots as S

KEYS = ["k"]
SCHEMA = "k long, ts int, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def newest(rows):
    return S.keep_latest(KEYS, ["ts", "v"])(rows)


def content(spark, path, version=None):
    return {(r.k, r.ts, r.v) for r in S.read(spark, path, version).collect()}


def test_merges_versions_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.read(spark, path) is None and S.lookup(spark, path, {"k": 1}) is None
    assert S.merge(frame(spark, [(i, 1, "a") for i in range(50)] + [(3, 0, "old"), (None, 1, "n")]), path, KEYS, newest, 0, "w", buckets=8) == 1
    assert S.merge(frame(spark, [(3, 2, "b"), (99, 2, "c")]), path, KEYS, newest, 1, "w") == 2
    before = content(spark, path)
    assert before == {(i, 1, "a") for i in range(50) if i != 3} | {(3, 2, "b"), (99, 2, "c"), (None, 1, "n")}
    # Given again, also after it was in part written, and from an older number.
    for number in (1, 0):
        assert S.merge(frame(spark, [(3, 9, "z")]), path, KEYS, newest, number, "w") == 2
    assert content(spark, path) == before and S.versions(spark, path) == [1, 2]
    # Another writer has numbers of its own, and versions stay readable.
    assert S.merge(frame(spark, [(4, 5, "d")]), path, KEYS, newest, 0, "x") == 3
    assert (4, 5, "d") in content(spark, path) and content(spark, path, 2) == before


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    S.merge(frame(spark, [(i, 1, "a") for i in range(200)]), path, KEYS, newest, buckets=16)
    one = S.manifest(spark, path)["buckets"]
    S.merge(frame(spark, [(5, 2, "b")]), path, KEYS, newest)
    two = S.manifest(spark, path)["buckets"]
    assert len(one) == 16 and len([b for b in one if one[b] != two[b]]) == 1
    assert [r.v for r in S.lookup(spark, path, {"k": 5}).collect()] == ["b"]
    files = S.lookup(spark, path, {"k": 5}).inputFiles()
    assert len({f.split("/bucket=")[1].split("/")[0] for f in files}) == 1
    assert S.lookup(spark, path, {"k": 5000}).count() == 0


def test_rows_that_go_empty_batches_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    S.merge(frame(spark, [(1, 1, "a"), (2, 1, "a")]), path, KEYS, newest, 0, buckets=1)
    assert S.merge(frame(spark, []), path, KEYS, newest, 1) == 2
    assert content(spark, path) == {(1, 1, "a"), (2, 1, "a")}
    S.merge(frame(spark, [(1, 2, "gone"), (2, 2, "gone")]), path, KEYS, lambda rows: newest(rows).filter("v <> 'gone'"), 2)
    assert S.read(spark, path).count() == 0 and S.manifest(spark, path)["buckets"] == {}
    S.merge(frame(spark, [(7, 3, "b")]), path, KEYS, newest, 3)
    assert len(S.vacuum(spark, path, keep=1)) == 2
    assert content(spark, path) == {(7, 3, "b")} and S.versions(spark, path) == [4] and S.vacuum(spark, path, keep=1) == []


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    S.merge(frame(spark, [(1, 1, "a")]), path, KEYS, newest, buckets=2)
    state = S.manifest(spark, path)
    S.merge(frame(spark, [(2, 1, "b")]), path, KEYS, newest)
    monkeypatch.setattr(S, "manifest", lambda *_: state)
    with pytest.raises(S.Conflict):
        S.merge(frame(spark, [(3, 1, "c")]), path, KEYS, newest)
    monkeypatch.undo()
    assert content(spark, path) == {(1, 1, "a"), (2, 1, "b")}
    assert not [f for f in (tmp_path / "t" / "manifest").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_wrong_keys(spark, tmp_path):
    S.merge(frame(spark, [(1, 1, "a")]), str(tmp_path / "t"), KEYS, newest)
    with pytest.raises(ValueError):
        S.merge(frame(spark, [(1, 1, "a")]), str(tmp_path / "t"), ["v"], newest)


def test_added_profiles_equal_the_whole(spark, tiny, tmp_path):
    from tallyloom.plans.tables import attempts

    rows = attempts(spark, tiny)
    added = S.add_up(["user_id", "topic"], ["attempted", "total", "passed"], ("since",))
    for i in range(4):
        S.merge(profiles.topic_counts(rows.filter(F.col("seq") % 4 == i)), str(tmp_path / "p"), ["user_id", "topic"], added, i)
    columns = ["user_id", "topic", "attempted", "accuracy", "strength"]
    got = profiles.topic_profile(S.read(spark, str(tmp_path / "p"))).select(columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in profiles.topic_accuracy(rows).select(columns).collect()}
