"""How driver tables stand in for learner tables.  The mapping is ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.dictionaries import INTENTS
from tallyloom.functions.scoring import clamp
from tallyloom.operators.matching import small

#: event_type: topic
EVENT_TOPICS = {"click": "DSA", "purchase": "OS", "error": "DBMS", "signup": "CN", "view": "OOP"}
BANK_TOPICS = ["DSA", "OS", "DBMS", "CN", "OOP"]
BANK_DIFFICULTIES = ["easy", "medium", "hard"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, ts, score, topic, intent, difficulty): an event is an attempt, its value the score."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    topic = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in EVENT_TOPICS.items()])
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").alias("seq"),
        "ts",
        clamp(F.col("value")).alias("score"),
        topic.alias("topic"),
        F.get(F.array(*map(F.lit, INTENTS)), k % 5).alias("intent"),
        F.when(k < 34, "easy").when(k < 67, "medium").otherwise("hard").alias("difficulty"),
        k.alias("k"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): each assistant turn answers the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("question", F.coalesce(before, F.lit("")))
    return rows.filter("role = 'assistant'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the benchmark item they are dealt to, by its place among the ids: (conv_id, turn, question, answer, slot, reference), slot being the item's id."""
    items = numbered(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slot"), F.col("text").alias("reference")), "slot")
    dealt = answers(spark, sf_dir).withColumn("place", F.col("conv_id") % F.lit(items.count()))
    return dealt.join(small(items), "place").drop("place")


def numbered(items: DataFrame, key: str) -> DataFrame:
    """items with ``place``, from 0 in order of their key; for a bank, which one task orders."""
    return items.withColumn("place", (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, text, topic, difficulty, intent) from benchmark items."""

    def dealt(names: list[str]) -> F.Column:
        return F.get(F.array(*map(F.lit, names)), (F.col("item_id") % len(names)).cast("int"))

    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"),
        "text",
        dealt(BANK_TOPICS).alias("topic"),
        dealt(BANK_DIFFICULTIES).alias("difficulty"),
        dealt(INTENTS).alias("intent"),
    )
