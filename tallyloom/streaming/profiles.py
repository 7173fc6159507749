"""Learner statistics kept up to date from a stream of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.scoring import level, strength
from tallyloom.operators.profiles import PASS


def topic_stats(attempts: DataFrame) -> DataFrame:
    """Running (user_id, topic) statistics; the sums are the whole state of a key."""
    stats = attempts.groupBy("user_id", "topic").agg(
        F.count("*").alias("attempted"),
        F.round(F.avg("score"), 6).alias("accuracy"),
        F.count_if(F.col("score") >= PASS).alias("passed"),
    )
    return stats.withColumn("strength", strength(F.col("attempted"), F.col("accuracy")))


def session_scores(attempts: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Mean score of each learner's sessions, closed by ``gap`` without attempts; later rows than ``late`` are dropped."""
    sessions = attempts.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return sessions.agg(F.count("*").alias("answers"), F.round(F.avg("score"), 6).alias("mean_score"))


def levels(attempts: DataFrame) -> DataFrame:
    stats = attempts.groupBy("user_id").agg(F.count("*").alias("attempted"), F.round(F.avg("score"), 6).alias("accuracy"))
    return stats.withColumn("level", level(F.col("attempted"), F.col("accuracy")))


def write_latest(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed rows of each batch under its own folder; readers take the last batch of a key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
