import datetime as dt
import random

import pytest

from tallyloom.operators import profiles
from tallyloom.sources import snapshots
from tallyloom.streaming import targets

SCHEMA = "user_id long, ts timestamp, seq long, score double"
START = dt.datetime(2024, 1, 1)


class Replay:
    """Attempts appended to a folder and followed by one stream after another."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def give(self, rows, late="2 days"):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")
        targets.run_targets(stream, f"{self.path}/table", f"{self.path}/checkpoint", late, buckets=2).awaitTermination()
        return {r.user_id: r for r in snapshots.read(self.spark, f"{self.path}/table").collect()}


def history(user, scores, per_day, seed=0):
    rng = random.Random(seed)
    return [(user, START + dt.timedelta(days=i // per_day, minutes=(i % per_day) * rng.choice([0, 1, 7])), i, float(s)) for i, s in enumerate(scores)]


def fold(spark, rows):
    return {r.user_id: (r.attempted, r.target) for r in profiles.target_difficulty(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.fixture
def replay(spark, tmp_path):
    return Replay(spark, str(tmp_path))


def test_replay_restart_and_repeat_equal_the_fold(spark, replay):
    rng = random.Random(8)
    cases = [([90] * 12, 6), ([90] * 12 + [0] * 14, 6), ([80] * 6 + [95] * 40, 6), ([0, 100, 85], 2), ([rng.choice([0, 40, 85, 100]) for _ in range(60)], 7)]
    rows = [r for u, (scores, per_day) in enumerate(cases) for r in history(u, scores, per_day, u)]
    rows.sort(key=lambda r: (r[1], r[2]))
    cut = [rows[: len(rows) // 3], rows[len(rows) // 3 : 70], rows[70:]]
    replay.give(cut[0])
    assert {u: (r.attempted, r.target) for u, r in replay.give(cut[1]).items()} == fold(spark, cut[0] + cut[1])
    version = snapshots.versions(spark, f"{replay.path}/table")[-1]
    again = replay.give(cut[1])
    assert {u: (r.attempted, r.target) for u, r in again.items()} == fold(spark, cut[0] + cut[1])
    assert snapshots.versions(spark, f"{replay.path}/table")[-1] >= version
    assert {u: (r.attempted, r.target) for u, r in replay.give(cut[2]).items()} == fold(spark, rows)


def test_a_timer_ends_a_session(replay):
    open_ = replay.give(history(1, [90] * 5, 5))[1]
    assert (open_.current, open_.target, open_.session) == ("easy", "medium", "2024-01-01")
    # Another learner's attempts carry the watermark past the day's end.
    for day in (9, 12):
        rows = replay.give([(2, START + dt.timedelta(days=day), day, 50.0)])
    assert (rows[1].current, rows[1].target, rows[1].session, rows[1].attempted) == ("medium", "medium", None, 5)
    # The next attempt starts a session of its own.
    later = replay.give([(1, START + dt.timedelta(days=13), 5, 95.0)])[1]
    assert (later.attempted, later.current, later.session) == (6, "medium", "2024-01-14")


def test_rows_without_time_or_value_and_late_ones(replay):
    rows = replay.give([(1, START, 1, 70.0), (1, None, 2, 70.0), (1, START, 3, None), (3, START, 1, None)])
    assert rows[1].attempted == 1 and 3 not in rows
    rows = replay.give([(1, START - dt.timedelta(hours=1), 0, 70.0), (1, START, 2, 80.0)])
    assert (rows[1].attempted, rows[1].accuracy) == (2, 75.0)


def test_the_session_setting_comes_back(spark, replay):
    before = spark.conf.get(targets.PROVIDER, None)
    replay.give([(1, START, 1, 70.0)])
    assert spark.conf.get(targets.PROVIDER, None) == before
