"""Question choice and dataset splits, reproducible by portable arithmetic instead of random draws.

A question bank is small: it rides along as one array row.  ``BANK_LIMIT``
is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scoring import adaptive_difficulty

BANK_LIMIT = 100_000


def bucket(user: Column, step: int = 0) -> Column:
    """0-99 by user and step."""
    return (user * 7919 + (step + 1) * 104_729) % 100


def strategy(user: Column, step: int = 0) -> Column:
    b = bucket(user, step)
    return F.when(b < 60, "weak_topic").when(b < 90, "weak_intent").otherwise("random")


def draw_key(user: Column, item: Column) -> Column:
    """A number by which the items of a user's draw are ordered."""
    return (item * 31 + user * 17) % 1009


def with_bank(learners: DataFrame, bank: DataFrame) -> DataFrame:
    """learners with the whole bank as an array column ``bank``, ordered by question_id."""
    if bank.limit(BANK_LIMIT + 1).count() > BANK_LIMIT:
        raise ValueError(f"the question bank has more than {BANK_LIMIT} rows; join it by topic instead")
    one = bank.agg(F.array_sort(F.collect_list(F.struct("question_id", "topic", "difficulty", "intent"))).alias("bank"))
    return learners.join(F.broadcast(one))


def next_questions(learners: DataFrame, bank: DataFrame, difficulty: str = "medium", topic: str = "All") -> DataFrame:
    """Open questions of each learner (user_id, asked array): matching ones, else any, else the session is completed."""
    open_ = F.filter("bank", lambda q: ~F.array_contains("asked", q["question_id"]))

    def matches(q: Column) -> Column:
        hit = F.lit(True) if difficulty == "All" else q["difficulty"] == difficulty
        return hit if topic == "All" else hit & F.contains(q["topic"], F.lit(topic))

    rows = with_bank(learners, bank).withColumn("open", open_).withColumn("exact", F.filter("open", matches))
    chosen = F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("open"))
    first = F.array_min(F.transform(chosen, lambda q: F.struct(draw_key(F.col("user_id"), q["question_id"]).alias("k"), q["question_id"].alias("id"))))
    status = F.when(F.size("exact") > 0, "success").when(F.size("open") > 0, "relaxed").otherwise("completed")
    return rows.select("user_id", F.size(chosen).alias("candidates"), first["id"].alias("question_id"), status.alias("status"))


def adaptive_choice(learners: DataFrame, bank: DataFrame, step: int = 0) -> DataFrame:
    """One question a learner by strategy, topic or intent, and difficulty.

    learners: (user_id, weak_topics, weak_intents arrays, target, accuracy as
    a map by topic); the target gives way to easy in a topic that goes badly.
    """
    rows = with_bank(learners, bank).withColumn("strategy", strategy(F.col("user_id"), step))
    turn = (F.col("user_id") + step).cast("int")
    topic = F.get("weak_topics", turn % F.size("weak_topics"))
    intent = F.when(F.size("weak_intents") > 0, F.get("weak_intents", turn % F.greatest(F.size("weak_intents"), F.lit(1))))
    rows = rows.withColumn("about", F.when(F.col("strategy") == "weak_topic", topic).when(F.col("strategy") == "weak_intent", intent))
    own = F.when(F.col("strategy") == "weak_topic", F.element_at("accuracy", F.col("about")))
    rows = rows.withColumn("target", adaptive_difficulty(F.col("target"), own))
    wanted = F.filter(
        "bank",
        lambda q: F.when(F.col("strategy") == "weak_topic", q["topic"] == F.col("about"))
        .when((F.col("strategy") == "weak_intent") & F.col("about").isNotNull(), q["intent"] == F.col("about"))
        .otherwise(True),
    )
    rows = rows.withColumn("wanted", wanted).withColumn("level", F.filter("wanted", lambda q: q["difficulty"] == F.col("target")))
    chosen = F.when(F.size("level") > 0, F.col("level")).otherwise(F.col("wanted"))
    first = F.array_min(F.transform(chosen, lambda q: F.struct(draw_key(F.col("user_id"), q["question_id"]).alias("k"), q["question_id"].alias("id"))))
    return rows.select("user_id", "strategy", "about", "target", F.size(chosen).alias("candidates"), first["id"].alias("question_id"))


def filtered(questions: DataFrame, topics: list[str] | None = None, difficulties: list[str] | None = None, intents: list[str] | None = None) -> DataFrame:
    """Questions (topics array) with any of the topics, and of the difficulties and intents; an empty list filters nothing."""
    if topics:
        questions = questions.filter(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    if difficulties:
        questions = questions.filter(F.col("difficulty").isin(difficulties))
    if intents:
        questions = questions.filter(F.col("intent").isin(intents))
    return questions


def split_key(row_id: Column, seed: int = 42) -> Column:
    return (row_id * 7919 + seed) % 10_007


def random_split(rows: DataFrame, row_id: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``fold``: test for about ``share`` of the rows, else train."""
    return rows.withColumn("fold", F.when(split_key(F.col(row_id), seed) < share * 10_007, "test").otherwise("train"))


def stratified_split(rows: DataFrame, row_id: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``fold`` with floor(share * size) test rows in each label, those with the smallest keys.

    Ranks come from sub-groups of the key, so that no task sorts a whole
    label: rows below the label's cut sub-group are test, rows above are
    train, and only rows of the cut sub-group are ranked.
    """
    key = split_key(F.col(row_id), seed)
    part = F.floor(key / 100)
    keyed = rows.withColumn("_key", key).withColumn("_part", part)
    sizes = keyed.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_wanted", F.floor(F.sum("_n").over(Window.partitionBy(label)) * share)).drop("_n")
    rank = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_key", row_id))
    placed = keyed.join(sizes, [label, "_part"]).withColumn("_rank", F.col("_before") + rank)
    fold = F.when(F.col("_rank") <= F.col("_wanted"), "test").otherwise("train")
    return placed.select(*rows.columns, fold.alias("fold"))


def topic_draw(bank: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n questions of each topic by a seeded order."""
    order = Window.partitionBy("topic").orderBy((F.col("question_id") * 31 + seed) % 1009, "question_id")
    return bank.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def synthetic_rows(spark, n: int = 500, seed: int = 1) -> DataFrame:
    """n rows of grading features from seeded draws."""
    from tallyloom.functions.scoring import grader_label

    rows = spark.range(n).select(
        F.col("id"),
        F.round(F.rand(seed), 3).alias("similarity"),
        F.round(F.rand(seed + 1), 3).alias("contradiction"),
        F.round(F.rand(seed + 2), 3).alias("entailment"),
        F.floor(F.rand(seed + 3) * 80 + 1).cast("int").alias("n_words"),
        F.rand(seed + 4).alias("_draw"),
    )
    label = grader_label(F.col("n_words"), F.col("contradiction"), F.col("entailment"), F.col("similarity"), F.col("_draw"))
    return rows.withColumn("label", label).drop("_draw")
