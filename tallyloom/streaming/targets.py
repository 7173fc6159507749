"""Each learner's target difficulty, kept by a stateful stream.

The state of a learner is a few numbers: attempts and their total, the
target, the open session (a day) with its attempts and total, and the place
of the last attempt.  An attempt takes one step of the target's rules; the
first attempt of another day, or a timer at the day's end once the
watermark is past it, ends the session, which may promote.  Rows come out
for every learner that a batch touches.

Within a batch a learner's rows are put in order of (ts, seq).  Rows at or
before the learner's last attempt are dropped, so a batch that is given
again, or late rows, change nothing; what is older than the watermark is
dropped by the engine.  Rows without a time or a score's value are dropped.
State is kept in RocksDB and restored from the checkpoint.

Ordered attempts give what ``profiles.target_difficulty`` gives for the
whole history, in column ``target``; ``current`` is the target before the
open session counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tallyloom.sources import snapshots

STATE = "n long, total decimal(38,6), target string, day string, answers long, day_total double, last_us long, last_seq long"
OUT = "user_id long, attempted long, accuracy double, current string, target string, session string, at_us long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor() -> StatefulProcessor:
    """The processor; its class is made here so that executors need no copy of this package."""
    import datetime as dt
    from decimal import ROUND_HALF_UP, Decimal

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    fields = STATE  # a local name goes with the class
    six = Decimal("0.000001")
    names = ["user_id", "attempted", "accuracy", "current", "target", "session", "at_us"]

    def rounded(x: float) -> float:
        return float(Decimal(repr(x)).quantize(six, ROUND_HALF_UP))

    def stepped(target: str, n: int, accuracy: float) -> str:
        if n < 3 or accuracy < 50:
            return "easy"
        return "hard" if accuracy >= 85 and target == "medium" and n >= 8 else target

    def closed(target: str, answers: int, day_total: float) -> str:
        """The target after a session."""
        return "medium" if target == "easy" and answers >= 5 and rounded(day_total / answers) >= 80 else target

    def day_end(day: str) -> int:
        """Milliseconds of the end of a day."""
        start = dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc)
        return int((start + dt.timedelta(days=1)).timestamp() * 1000)

    def shown(user_id: int, state: tuple) -> pd.DataFrame:
        n, total, target, day, answers, day_total, last_us, _ = state
        after = closed(target, answers, day_total) if day else target
        return pd.DataFrame([[user_id, n, rounded(float(total) / n), target, after, day, last_us]], columns=names)

    class Targets(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.learner = handle.getValueState("learner", fields)

        def handleInputRows(self, key, rows, timerValues):
            given = []
            for frame in rows:
                given += zip(frame["us"].tolist(), frame["seq"].tolist(), frame["score"].tolist())
            given = [r for r in given if r[0] is not None and r[0] == r[0] and r[2] is not None and r[2] == r[2]]
            given.sort(key=lambda r: (r[0], r[1] is None or r[1] != r[1], r[1]))
            known = self.learner.get() if self.learner.exists() else (0, Decimal(0), "easy", None, 0, 0.0, None, None)
            n, total, target, day, answers, day_total, last_us, last_seq = known
            timed = day  # each call of the state store is a round trip: only the last day is to have a timer
            for us, seq, score in given:
                if last_us is not None and (us, seq) <= (last_us, last_seq):
                    continue
                today = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)).date().isoformat()
                if today != day:
                    if day:
                        target = closed(target, answers, day_total)
                    day, answers, day_total = today, 0, 0.0
                n, total = n + 1, total + Decimal(repr(score)).quantize(six, ROUND_HALF_UP)
                answers, day_total = answers + 1, day_total + score
                target = stepped(target, n, rounded(float(total) / n))
                last_us, last_seq = us, seq
            if not n:
                return
            if day != timed:
                if timed:
                    self.handle.deleteTimer(day_end(timed))
                self.handle.registerTimer(day_end(day))
            state = (n, total, target, day, answers, day_total, last_us, last_seq)
            self.learner.update(state)
            yield shown(key[0], state)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            n, total, target, day, answers, day_total, last_us, last_seq = self.learner.get()
            if day and day_end(day) <= expiredTimerInfo.getExpiryTimeInMs():
                state = (n, total, closed(target, answers, day_total), None, 0, 0.0, last_us, last_seq)
                self.learner.update(state)
                yield shown(key[0], state)

        def close(self) -> None:
            pass

    return Targets()


def target_states(attempts: DataFrame, late: str = "2 days") -> DataFrame:
    """(user_id, attempted, accuracy, current, target, session, at_us) of the learners that each batch touches.

    attempts: a stream of (user_id, ts, seq, score); ``late`` is how far rows
    may lag behind the newest one.
    """
    rows = attempts.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("score").cast("double").alias("score"))
    rows = rows.filter(F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=_processor(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of queries that start within; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def merged_into(path: str, keys: list[str], combine: snapshots.Combine, writer: str, buckets: int = snapshots.BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges each batch into a snapshot table under its number, so that one given twice counts once."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # a stateful batch is not to be run twice
        try:
            snapshots.merge(held, path, keys, combine, number, writer, buckets)
        finally:
            held.unpersist()

    return write


def run_targets(attempts: DataFrame, table: str, checkpoint: str, late: str = "2 days", buckets: int = 16) -> StreamingQuery:
    """Follow a stream of attempts until all that is there is done; each learner's last state is in the snapshot table."""
    with _rocks(attempts.sparkSession):
        states = target_states(attempts, late)
        newest = snapshots.keep_latest(["user_id"], ["attempted", "at_us", "closed"])
        # Of one attempt's rows the one after the session's end is the later.
        states = states.withColumn("closed", F.col("session").isNull())
        write = merged_into(table, ["user_id"], newest, f"targets:{checkpoint}", buckets)
        return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
