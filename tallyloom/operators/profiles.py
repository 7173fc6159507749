"""Learner profiles from attempts: rollups, running levels and the target-difficulty fold.

Attempts have (user_id, ts, seq, score 0-100, topic, intent, difficulty);
``seq`` breaks ties of ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.dictionaries import DIFFICULTIES, WEAK_TOPIC_DEFAULT
from tallyloom.functions.scoring import level, strength

PASS = 60
#: Attempts of a learner folded in one array; longer histories are folded in pieces.
PIECE = 512


def _accuracy() -> Column:
    return F.round(F.avg("score"), 6).alias("accuracy")


def topic_accuracy(attempts: DataFrame) -> DataFrame:
    """Mean score and strength of each learner in each topic, with pass counts by difficulty."""
    passed = F.col("score") >= PASS
    counts = [
        c
        for d in DIFFICULTIES
        for c in (
            F.count_if(F.col("difficulty") == d).alias(f"{d}_attempted"),
            F.count_if((F.col("difficulty") == d) & passed).alias(f"{d}_correct"),
        )
    ]
    stats = attempts.groupBy("user_id", "topic").agg(F.count("*").alias("attempted"), _accuracy(), *counts)
    return stats.withColumn("strength", strength(F.col("attempted"), F.col("accuracy")))


def topic_counts(attempts: DataFrame) -> DataFrame:
    """(user_id, topic, attempted, total, passed, since): what can be added up from batch to batch."""
    return attempts.groupBy("user_id", "topic").agg(
        F.count("*").alias("attempted"),
        F.sum(F.col("score").cast("decimal(18,6)")).cast("decimal(38,6)").alias("total"),
        F.count_if(F.col("score") >= PASS).alias("passed"),
        F.min(F.struct("ts", "seq")).alias("since"),
    )


def topic_profile(counts: DataFrame) -> DataFrame:
    """Accuracy and strength from added counts."""
    accuracy = F.round(F.col("total").cast("double") / F.col("attempted"), 6)
    rows = counts.withColumn("accuracy", accuracy)
    return rows.select("user_id", "topic", "attempted", "passed", "accuracy", strength(F.col("attempted"), F.col("accuracy")).alias("strength"))


def rollup(attempts: DataFrame) -> DataFrame:
    """Overall, by topic, by topic and difficulty, and by intent, in one pass."""
    sets = [["user_id"], ["user_id", "topic"], ["user_id", "topic", "difficulty"], ["user_id", "intent"]]
    return attempts.groupingSets(sets, "user_id", "topic", "difficulty", "intent").agg(
        F.count("*").alias("attempted"), _accuracy(), F.count_if(F.col("score") >= PASS).alias("passed")
    )


def _counted(attempts: DataFrame) -> DataFrame:
    """attempts with day, n (attempts so far) and acc (accuracy so far).

    Totals are carried from day to day and rows are ordered within a day only,
    so no task sorts a learner's whole history.  Sums are of decimals, which
    do not depend on how rows are grouped.
    """
    score = F.col("score").cast("decimal(18,6)")
    rows = attempts.withColumn("day", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")))
    days = rows.groupBy("user_id", "day").agg(F.count("*").alias("_n"), F.sum(score).alias("_sum"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col("user_id").alias("_user"), F.col("day").alias("_day"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_sum")])
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("day") == F.col("_day"))
    today = Window.partitionBy("user_id", "day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, same).withColumn("n", F.col("_n") + F.count("*").over(today))
    total = (F.col("_sum") + F.coalesce(F.sum(score).over(today), F.lit(0))).cast("double")
    return joined.withColumn("acc", F.round(total / F.col("n"), 6)).drop("_user", "_day", "_n", "_sum")


def running_level(attempts: DataFrame) -> DataFrame:
    """Attempts so far, accuracy so far and the level, after each attempt."""
    return _counted(attempts).select("user_id", "seq", F.col("n").alias("attempted"), F.col("acc").alias("accuracy")).withColumn("level", level(F.col("attempted"), F.col("accuracy")))


def session_stats(attempts: DataFrame) -> DataFrame:
    """Size and mean of each learner's sessions (days), and whether the mean earns a promotion."""
    stats = attempts.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("answers"), F.round(F.avg("score"), 6).alias("mean_score"))
    return stats.withColumn("promotes", (F.col("answers") >= 5) & (F.col("mean_score") >= 80))


def target_difficulty(attempts: DataFrame) -> DataFrame:
    """(user_id, attempted, target): the target after all attempts and session ends, starting from easy.

    A step maps each of the three targets to one, and steps compose, so a
    history is folded in pieces of PIECE attempts and the pieces' maps are
    then composed; no array grows with a learner's history beyond that.
    """
    day = Window.partitionBy("user_id", "day")
    steps = (
        _counted(attempts)
        .withColumn("last", F.row_number().over(Window.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("seq"))) == 1)
        .withColumn("up", F.col("last") & (F.count("*").over(day) >= 5) & (F.round(F.avg("score").over(day), 6) >= 80))
    )

    def after(state: str) -> Column:
        moved = (
            F.when(F.col("n") < 3, "easy")
            .when((F.col("acc") < 50) & (F.lit(state) != "easy"), "easy")
            .when((F.col("acc") >= 85) & (F.lit(state) == "medium") & (F.col("n") >= 8), "hard")
            .otherwise(state)
        )
        return F.when(F.col("up") & (moved == "easy"), "medium").otherwise(moved)

    step = F.struct(*[after(s).alias(s) for s in DIFFICULTIES])
    same = F.struct(*[F.lit(s).alias(s) for s in DIFFICULTIES])

    def then(a: Column, b: Column) -> Column:
        def through(s: Column) -> Column:
            return F.when(s == "easy", b["easy"]).when(s == "medium", b["medium"]).otherwise(b["hard"])

        return F.struct(*[through(a[s]).alias(s) for s in DIFFICULTIES])

    def composed(parts: Column) -> Column:
        return F.aggregate(F.transform(F.array_sort(parts), lambda x: x["step"]), same, then)

    piece = F.floor((F.col("n") - 1) / PIECE)
    pieces = steps.groupBy("user_id", piece.alias("piece")).agg(composed(F.collect_list(F.struct("n", step.alias("step")))).alias("step"), F.count("*").alias("k"))
    whole = pieces.groupBy("user_id").agg(F.sum("k").alias("attempted"), composed(F.collect_list(F.struct("piece", "step"))).alias("step"))
    return whole.select("user_id", "attempted", F.col("step.easy").alias("target"))


def _listed(stats: DataFrame, name: str, keep: Column) -> DataFrame:
    """(user_id, items): names that are kept, in order of first appearance, joined by commas; null if none."""
    order = F.array_sort(F.collect_list(F.when(keep, F.struct("since", name))))
    return stats.groupBy("user_id").agg(F.array_join(F.transform(order, lambda x: x[name]), ",").alias("items"))


def _by(attempts: DataFrame, name: str) -> DataFrame:
    return attempts.groupBy("user_id", name).agg(
        F.count("*").alias("attempted"),
        F.round(F.avg("score"), 6).alias("accuracy"),
        F.round(F.count_if(F.col("score") >= PASS) * 100 / F.count("*"), 6).alias("share"),
        F.min(F.struct("ts", "seq")).alias("since"),
    )


def weak_topics(attempts: DataFrame) -> DataFrame:
    stats = _by(attempts, "topic")
    found = _listed(stats, "topic", (F.col("attempted") >= 2) & (strength(F.col("attempted"), F.col("accuracy")) == "weak"))
    default = F.lit(",".join(WEAK_TOPIC_DEFAULT))
    return found.select("user_id", F.when(F.col("items") == "", default).otherwise(F.col("items")).alias("weak_topics"))


def strong_topics(attempts: DataFrame) -> DataFrame:
    stats = _by(attempts, "topic")
    found = _listed(stats, "topic", (F.col("attempted") >= 2) & (strength(F.col("attempted"), F.col("accuracy")) == "strong"))
    return found.withColumnRenamed("items", "strong_topics")


def weak_intents(attempts: DataFrame) -> DataFrame:
    stats = _by(attempts, "intent")
    found = _listed(stats, "intent", (F.col("attempted") >= 2) & (F.col("share") < PASS))
    return found.withColumnRenamed("items", "weak_intents")


def profile_records(attempts: DataFrame, as_of: str) -> DataFrame:
    """One nested record a learner, as stored: totals and a map of topic statistics."""
    topics = topic_accuracy(attempts)
    fields = [c for c in topics.columns if c not in ("user_id", "topic", "strength")]
    maps = topics.groupBy("user_id").agg(
        F.sum("attempted").alias("total_attempted"),
        F.round(F.sum(F.col("accuracy") * F.col("attempted") / 100), 6).alias("total_correct"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", F.struct(*fields).alias("stats"))))).alias("topic_stats"),
    )
    return maps.withColumn("updated_at", F.lit(as_of))


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key: an upsert in which the latest write wins."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("_no", F.row_number().over(order)).filter("_no = 1").drop("_no")
