"""Queries on attempts, question banks, labels and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import dictionaries as D
from tallyloom.functions import scoring as S
from tallyloom.functions.classify import by_score, label_index, multi_hot, top_label
from tallyloom.functions.extract import experience_level
from tallyloom.functions.vectors import as_double, cosine, sigmoid, softmax
from tallyloom.operators import grading, matching, metrics, profiles, selection, vector_index
from tallyloom.plans import duck
from tallyloom.plans.registry import Registry
from tallyloom.plans.tables import attempts, bank, numbered, table
from tallyloom.sources import io, snapshots
from tallyloom.streaming import targets

register = Registry()
QUERIES, SQL = register.queries, register.sql

_ATT = "WITH " + duck.ATTEMPTS


def _counts() -> str:
    return ", ".join(
        f"count(*) FILTER (difficulty = '{d}') AS {d}_attempted, count(*) FILTER (difficulty = '{d}' AND score >= 60) AS {d}_correct" for d in D.DIFFICULTIES
    )


@register(f"""{_ATT}, s AS (SELECT user_id, topic, count(*) AS attempted, round(avg(score), 6) AS accuracy, {_counts()} FROM attempts GROUP BY ALL)
SELECT *, {duck.strength("attempted", "accuracy")} AS strength FROM s""")
def topic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, pass counts by difficulty and strength of each learner and topic."""
    return profiles.topic_accuracy(attempts(spark, sf_dir))


@register(f"""{_ATT} SELECT user_id, topic, difficulty, intent, count(*) AS attempted, round(avg(score), 6) AS accuracy, count(*) FILTER (score >= 60) AS passed
FROM attempts GROUP BY GROUPING SETS ((user_id), (user_id, topic), (user_id, topic, difficulty), (user_id, intent))""")
def profile_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: all levels of a profile at once."""
    return profiles.rollup(attempts(spark, sf_dir))


_RUN = f"""{_ATT}, r AS (SELECT user_id, seq, count(*) OVER w AS attempted, round(sum(score::DECIMAL(18, 6)) OVER w::DOUBLE / count(*) OVER w, 6) AS accuracy
FROM attempts WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"""


@register(f"{_RUN} SELECT *, {duck.level('attempted', 'accuracy')} AS level FROM r")
def running_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals and level after each attempt."""
    return profiles.running_level(attempts(spark, sf_dir))


_SESSION = f"""{_ATT}, s AS (SELECT user_id, ts::DATE AS day, count(*) AS answers, round(avg(score), 6) AS mean_score FROM attempts GROUP BY ALL)"""


@register(f"{_SESSION} SELECT user_id, day::VARCHAR AS day, answers, mean_score, answers >= 5 AND mean_score >= 80 AS promotes FROM s")
def session_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (days), their mean and whether it promotes."""
    return profiles.session_stats(attempts(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


_FOLD = f"""WITH RECURSIVE {duck.ATTEMPTS}, day AS (SELECT user_id, ts::DATE AS day, count(*) AS c, round(avg(score), 6) AS m FROM attempts GROUP BY ALL),
steps AS (
  SELECT a.user_id, row_number() OVER w AS n, round(sum(score::DECIMAL(18, 6)) OVER w::DOUBLE / row_number() OVER w, 6) AS acc,
         row_number() OVER (PARTITION BY a.user_id, a.ts::DATE ORDER BY ts DESC, seq DESC) = 1 AND c >= 5 AND m >= 80 AS up
  FROM attempts a JOIN day d ON a.user_id = d.user_id AND a.ts::DATE = d.day WINDOW w AS (PARTITION BY a.user_id ORDER BY ts, seq)
), fold AS (
  SELECT user_id, 0::BIGINT AS n, 'easy' AS target FROM (SELECT DISTINCT user_id FROM attempts)
  UNION ALL
  SELECT user_id, n, CASE WHEN up AND moved = 'easy' THEN 'medium' ELSE moved END FROM (
    SELECT s.user_id, s.n, up, CASE WHEN s.n < 3 THEN 'easy' WHEN acc < 50 AND target <> 'easy' THEN 'easy'
           WHEN acc >= 85 AND target = 'medium' AND s.n >= 8 THEN 'hard' ELSE target END AS moved
    FROM fold f JOIN steps s ON s.user_id = f.user_id AND s.n = f.n + 1)
), goal AS (SELECT user_id, max(n) AS attempted, max_by(target, n) AS target FROM fold GROUP BY user_id)"""


@register(f"{_FOLD} SELECT user_id, attempted, target FROM goal")
def target_difficulty_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target difficulty after the whole history."""
    return profiles.target_difficulty(attempts(spark, sf_dir))


@register(f"{_FOLD} SELECT user_id, attempted, target FROM goal")
def stateful_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 W4 and the stateful update of section 2.11: attempts replayed as a stream in three parts, the second of them given twice, with a restart from the checkpoint before each."""
    rows = attempts(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "score")
    path = io.scratch(spark, "replay")
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - F.lit(low)) * 3 / (F.lit(high) - F.lit(low) + 1))
    for i in (0, 1, 1, 2):
        rows.filter(part == i).write.mode("append").parquet(f"{path}/attempts")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/attempts")
        targets.run_targets(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return snapshots.read(spark, f"{path}/table").select("user_id", "attempted", "target")


@register(f"""{_ATT}, s AS (SELECT user_id, topic, count(*) AS attempted, count(*) FILTER (score >= 60) AS passed, round(sum(score::DECIMAL(18, 6))::DOUBLE / count(*), 6) AS accuracy FROM attempts GROUP BY ALL)
SELECT *, {duck.strength("attempted", "accuracy")} AS strength, 3 AS version FROM s""")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 K2 A1: profiles kept by merging three batches of attempts, the second given twice, and read back with the table's version."""
    counts = [profiles.topic_counts(attempts(spark, sf_dir).filter(F.col("seq") % 3 == i)) for i in range(3)]
    path = io.scratch(spark, "profiles")
    added = snapshots.add_up(["user_id", "topic"], ["attempted", "total", "passed"], ("since",))
    for i in (0, 1, 1, 2):
        version = snapshots.merge(counts[i], path, ["user_id", "topic"], added, i, "attempts")
    return profiles.topic_profile(snapshots.read(spark, path)).withColumn("version", F.lit(version))


@register("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache to which three batches of entries are written in any order of time; the latest entry of each key stays."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    path, keys = io.scratch(spark, "cache"), ["user_id", "event_type"]
    for i in range(3):
        snapshots.merge(rows.filter(F.col("event_id") % 3 == i), path, keys, snapshots.keep_latest(keys, ["ts", "event_id"]), i)
    return snapshots.read(spark, path).select("user_id", "event_type", "event_id", "value")


@register(f"""{_FOLD}, t AS (SELECT user_id, topic, count(*) AS attempted, round(avg(score), 6) AS accuracy FROM attempts GROUP BY ALL)
SELECT user_id, topic, accuracy, target, CASE WHEN accuracy < 40 THEN 'easy' ELSE target END AS difficulty,
  'Focus on ' || topic || ' to improve. You''re at ' || {duck.level("attempted", "accuracy")} || ' level.' AS advice FROM t JOIN goal USING (user_id)""".replace("t JOIN goal", "t JOIN (SELECT user_id, target FROM goal) g"))
def topic_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difficulty to ask in each topic, from the learner's target and the accuracy there, and advice on that topic alone."""
    rows = attempts(spark, sf_dir)
    goal = profiles.target_difficulty(rows).select("user_id", "target")
    stats = profiles.topic_accuracy(rows).select("user_id", "topic", "attempted", "accuracy").join(goal, "user_id")
    advice = S.recommendation(F.array("topic"), S.level(F.col("attempted"), F.col("accuracy")))
    return stats.select("user_id", "topic", "accuracy", "target", S.adaptive_difficulty(F.col("target"), F.col("accuracy")).alias("difficulty"), advice.alias("advice"))


_ADVICE = "attempted >= 2 AND " + duck.strength("attempted", "accuracy") + " = 'weak'"


@register(f"""{_ATT}, s AS (SELECT user_id, topic, count(*) AS attempted, round(avg(score), 6) AS accuracy, min(struct_pack(ts := ts, seq := seq)) AS since FROM attempts GROUP BY ALL),
w AS (SELECT user_id, coalesce(string_agg(topic, ', ' ORDER BY since) FILTER ({_ADVICE}), 'DSA, OS') AS weak FROM s GROUP BY user_id),
o AS (SELECT user_id, count(*) AS attempted, round(avg(score), 6) AS accuracy FROM attempts GROUP BY user_id)
SELECT user_id, 'Focus on ' || weak || ' to improve. You''re at ' || {duck.level("attempted", "accuracy")} || ' level.' AS advice FROM w JOIN o USING (user_id)""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: advice to each learner from weak topics and level; the default topics stand in where none is weak, so nobody is praised."""
    rows = attempts(spark, sf_dir)
    weak = profiles.weak_topics(rows).select("user_id", F.split("weak_topics", ",").alias("weak"))
    own = rows.groupBy("user_id").agg(F.count("*").alias("attempted"), F.round(F.avg("score"), 6).alias("accuracy"))
    return weak.join(own, "user_id").select("user_id", S.recommendation(F.col("weak"), S.level(F.col("attempted"), F.col("accuracy"))).alias("advice"))


def _listing(name: str, keep: str, start: str = _ATT) -> str:
    return f"""{start}, s AS (SELECT user_id, {name}, count(*) AS attempted, round(avg(score), 6) AS accuracy,
       round(count(*) FILTER (score >= 60) * 100 / count(*), 6) AS share, min(struct_pack(ts := ts, seq := seq)) AS since FROM attempts GROUP BY ALL),
l AS (SELECT user_id, coalesce(string_agg({name}, ',' ORDER BY since) FILTER ({keep}), '') AS items FROM s GROUP BY user_id)"""


_WEAK = "attempted >= 2 AND " + duck.strength("attempted", "accuracy") + " = 'weak'"
_STRONG = "attempted >= 2 AND " + duck.strength("attempted", "accuracy") + " = 'strong'"


@register(f"{_listing('topic', _WEAK)} SELECT user_id, CASE WHEN items = '' THEN 'DSA,OS' ELSE items END AS weak_topics FROM l")
def weak_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: weak topics in order of first attempt, or the default."""
    return profiles.weak_topics(attempts(spark, sf_dir))


@register(f"{_listing('topic', _STRONG)} SELECT user_id, items AS strong_topics FROM l")
def strong_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return profiles.strong_topics(attempts(spark, sf_dir))


@register(f"{_listing('intent', 'attempted >= 2 AND share < 60')} SELECT user_id, items AS weak_intents FROM l")
def weak_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return profiles.weak_intents(attempts(spark, sf_dir))


@register(f"""{_ATT}, s AS (SELECT user_id, topic, count(*) AS attempted, round(avg(score), 6) AS accuracy FROM attempts GROUP BY ALL)
SELECT user_id, sum(attempted)::BIGINT AS total_attempted, round(sum(accuracy * attempted / 100), 6) AS total_correct,
       string_agg(topic || '=' || attempted, ';' ORDER BY topic) AS topics FROM s GROUP BY user_id""")
def profile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested profiles through JSON and back."""
    records = profiles.profile_records(attempts(spark, sf_dir), "2024-06-01T00:00:00")
    schema = records.schema
    back = records.select(F.from_json(F.to_json(F.struct(*records.columns)), schema).alias("p")).select("p.*")
    each = F.transform(F.map_entries("topic_stats"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["attempted"].cast("string")))
    return back.select("user_id", "total_attempted", "total_correct", F.array_join(F.array_sort(each), ";").alias("topics"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners with the bank items their attempts stand for: events are dealt over the whole bank."""
    items = numbered(bank(spark, sf_dir).select("question_id"), "question_id")
    rows = attempts(spark, sf_dir).withColumn("place", F.col("seq") % F.lit(items.count()))
    return rows.join(matching.small(items), "place").groupBy("user_id").agg(F.collect_set("question_id").alias("asked"))


_ASKED = f"{_ATT}, {duck.BANK}, items AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS place, count(*) OVER () AS n FROM bank), asked AS (SELECT DISTINCT user_id, question_id AS item FROM attempts JOIN items ON place = seq % n), users AS (SELECT DISTINCT user_id FROM attempts)"


@register(f"""{_ASKED}, o AS (
  SELECT user_id, question_id, difficulty = 'medium' AND contains(topic, 'OS') AS exact, (question_id * 31 + user_id * 17) % 1009 AS k
  FROM users, bank b WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.user_id = users.user_id AND a.item = b.question_id)
), m AS (SELECT *, bool_or(exact) OVER (PARTITION BY user_id) AS any_fit FROM o), c AS (
  SELECT user_id, count(*) AS candidates, arg_min(question_id, struct_pack(k := k, q := question_id)) AS question_id, bool_or(any_fit) AS any_fit FROM m WHERE exact = any_fit OR exact GROUP BY user_id)
SELECT user_id, coalesce(candidates, 0)::INT AS candidates, question_id, CASE WHEN any_fit THEN 'success' WHEN candidates > 0 THEN 'relaxed' ELSE 'completed' END AS status
FROM users LEFT JOIN c USING (user_id)""")
def next_question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unasked matching question, else any unasked one, else the end."""
    return selection.next_questions(_asked(spark, sf_dir), bank(spark, sf_dir), "medium", "OS")


@register(f"""{_ATT} SELECT DISTINCT user_id, ((user_id * 7919 + 104729) % 100)::BIGINT AS bucket,
CASE WHEN (user_id * 7919 + 104729) % 100 < 60 THEN 'weak_topic' WHEN (user_id * 7919 + 104729) % 100 < 90 THEN 'weak_intent' ELSE 'random' END AS strategy FROM attempts""")
def strategy_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60/30/10 choice by arithmetic on ids."""
    users = attempts(spark, sf_dir).select("user_id").distinct()
    return users.select("user_id", selection.bucket(F.col("user_id")).alias("bucket"), selection.strategy(F.col("user_id")).alias("strategy"))


_CHOICE = _listing("topic", _WEAK, _FOLD) + f""", li AS (SELECT user_id, coalesce(string_agg(intent, ',' ORDER BY since) FILTER (attempted >= 2 AND share < 60), '') AS intents FROM (
  SELECT user_id, intent, count(*) AS attempted, round(count(*) FILTER (score >= 60) * 100 / count(*), 6) AS share, min(struct_pack(ts := ts, seq := seq)) AS since FROM attempts GROUP BY ALL) GROUP BY user_id),
{duck.BANK}, u AS (
  SELECT user_id, string_split(CASE WHEN items = '' THEN 'DSA,OS' ELSE items END, ',') AS wt, list_filter(string_split(intents, ','), lambda x: x <> '') AS wi,
         CASE WHEN (user_id * 7919 + 104729) % 100 < 60 THEN 'weak_topic' WHEN (user_id * 7919 + 104729) % 100 < 90 THEN 'weak_intent' ELSE 'random' END AS strategy
  FROM l JOIN li USING (user_id)
), v AS (SELECT user_id, strategy, CASE strategy WHEN 'weak_topic' THEN wt[1 + user_id % len(wt)] WHEN 'weak_intent' THEN CASE WHEN len(wi) > 0 THEN wi[1 + user_id % len(wi)] END END AS about FROM u
), t AS (SELECT v.*, CASE WHEN strategy = 'weak_topic' AND accuracy < 40 THEN 'easy' ELSE target END AS target FROM v JOIN goal USING (user_id) LEFT JOIN (SELECT user_id, topic AS about, accuracy FROM s) USING (user_id, about)
), w AS (SELECT t.*, question_id, difficulty = target AS fits, (question_id * 31 + user_id * 17) % 1009 AS k FROM t JOIN bank ON
  CASE WHEN strategy = 'weak_topic' THEN topic = about WHEN strategy = 'weak_intent' AND about IS NOT NULL THEN intent = about ELSE true END
), x AS (SELECT *, bool_or(fits) OVER (PARTITION BY user_id) AS any_fit FROM w)
SELECT user_id, strategy, about, target, count(*)::INT AS candidates, arg_min(question_id, struct_pack(k := k, q := question_id)) AS question_id
FROM x WHERE fits OR NOT any_fit GROUP BY user_id, strategy, about, target"""


@register(_CHOICE)
def adaptive_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question a learner by strategy, at the learner's target, easy in a topic that goes badly; the difficulty gives way where none fits."""
    rows = attempts(spark, sf_dir)
    topics = profiles.weak_topics(rows).select("user_id", F.split("weak_topics", ",").alias("weak_topics"))
    intents = profiles.weak_intents(rows).select("user_id", F.array_remove(F.split("weak_intents", ","), "").alias("weak_intents"))
    goal = profiles.target_difficulty(rows).select("user_id", "target")
    accuracy = profiles.topic_accuracy(rows).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "accuracy"))).alias("accuracy"))
    learners = topics.join(intents, "user_id").join(goal, "user_id").join(accuracy, "user_id")
    return selection.adaptive_choice(learners, bank(spark, sf_dir))


@register(f"WITH {duck.BANK} SELECT question_id, topic, difficulty, intent FROM bank WHERE topic IN ('DSA', 'CN') AND difficulty IN ('easy', 'hard')")
def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of the topics and of the difficulties; the empty intent list filters nothing."""
    rows = bank(spark, sf_dir).withColumn("topics", F.array("topic"))
    return selection.filtered(rows, ["DSA", "CN"], ["easy", "hard"], []).select("question_id", "topic", "difficulty", "intent")


@register(f"WITH {duck.BANK} SELECT topic, question_id, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY (question_id * 31 + 7) % 1009, question_id) AS place FROM bank) WHERE place <= 3")
def quiz_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions of each topic."""
    return selection.topic_draw(bank(spark, sf_dir), 3).select("topic", "question_id", F.col("place").cast("long").alias("place"))


@register("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(q.e, v.e) * list_distance(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score, round(1 / (1 + score), 6) AS relevance FROM r WHERE rank <= 5""")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest by squared distance; queries are the ids divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return matching.nearest(rows.filter("vec_id % 100 = 0"), rows, 5, "l2")


@register("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score, round(1 / (1 + score), 6) AS relevance FROM r WHERE rank <= 5""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest by cosine."""
    rows = table(spark, sf_dir, "embeddings")
    return matching.nearest(rows.filter("vec_id % 100 = 0"), rows, 5, "cosine")


_INDEXED = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.label, round({}, 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {}, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score, round(1 / (1 + score), 6) AS relevance, label FROM r WHERE rank <= 5"""


def _indexed(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "embeddings"), io.scratch(spark, "index")
    vector_index.write_index(rows, path, by, keep=("label",))
    return vector_index.search(spark, path, rows.filter("vec_id % 100 = 0"), 5, exact=True)


@register(_INDEXED.format("list_distance(q.e, v.e) * list_distance(q.e, v.e)", "ASC"))
def index_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored inverted file, searched until nothing nearer can be elsewhere, with what stands beside the vectors."""
    return _indexed(spark, sf_dir, "l2")


@register(_INDEXED.format("list_cosine_similarity(q.e, v.e)", "DESC"))
def index_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cosine."""
    return _indexed(spark, sf_dir, "cosine")


@register(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (
  SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 4) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, similarity, round(similarity * 100, 2) AS percent, {duck.banded("round(similarity * 100, 2)", [(80, "A"), (70, "B"), (60, "C"), (50, "D")], "F")} AS grade FROM p""")
def cosine_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the next, as a grade."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("e"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    rows = v.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("e"), F.col("f")), 4).alias("similarity"))
    rows = rows.withColumn("percent", F.round(F.col("similarity") * 100, 2))
    return rows.withColumn("grade", S.letter_grade(F.col("percent")))


@register("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (
  SELECT label AS domain, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY ALL) GROUP BY label
), p AS (SELECT vec_id, domain, round(list_cosine_similarity(e, c), 6) AS a, exp(-(list_distance(e, c) * list_distance(e, c))) AS x FROM v, c
), b AS (SELECT vec_id, domain, round(0.4 * a + 0.6 * round(CASE WHEN sum(x) OVER w > 0 THEN x / sum(x) OVER w ELSE 0 END, 6), 4) AS confidence FROM p WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, arg_max(domain, struct_pack(c := confidence, d := -domain)) AS domain, max(confidence) AS confidence FROM b GROUP BY vec_id""")
def domain_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest label centre blended with a softmax over distances."""
    rows = table(spark, sf_dir, "embeddings")
    return matching.domain_ensemble(rows, matching.centroids(rows))


@register("""WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * greatest(n, 1)), 6) AS weight FROM c""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return metrics.class_weights(table(spark, sf_dir, "labels"), "quality")


@register("""WITH s AS (SELECT count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS returned, sum((l_linestatus = 'O')::INT)::BIGINT AS open FROM lineitem)
SELECT 'returned' AS label, returned AS positives, round((n - returned) / greatest(returned, 1), 6) AS weight FROM s
UNION ALL SELECT 'open', open, round((n - open) / greatest(open, 1), 6) FROM s""")
def pos_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open"))
    return metrics.positive_weights(rows, ["returned", "open"])


_REPORT = """WITH l AS (SELECT DISTINCT unnest([quality, toxic]) AS label FROM labels), c AS (
  SELECT label, (SELECT count(*) FROM labels WHERE quality = label) AS support, (SELECT count(*) FROM labels WHERE toxic = label) AS called,
         (SELECT count(*) FROM labels WHERE quality = label AND toxic = label) AS tp FROM l
), r AS (SELECT label, round(CASE WHEN called > 0 THEN tp / called ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
         round(CASE WHEN support + called > 0 THEN 2 * tp / (support + called) ELSE 0 END, 6) AS f1, support FROM c)"""


@register(f"{_REPORT} SELECT * FROM r")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the truth, toxic as the call."""
    return metrics.report(table(spark, sf_dir, "labels"), "quality", "toxic")


@register(f"{_REPORT} SELECT (SELECT round(avg((quality = toxic)::INT), 6) FROM labels) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM r")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return metrics.single_label(table(spark, sf_dir, "labels"), "quality", "toxic")


@register("""WITH s AS (SELECT quality = 1 AS t1, toxic = 1 AS t2, (doc_id % 10) / 10 >= 0.5 AS p1, (doc_id % 7) / 7 >= 0.5 AS p2 FROM labels),
c AS (SELECT sum((t1 AND p1)::INT + (t2 AND p2)::INT) AS tp, sum(p1::INT + p2::INT) AS pp, sum(t1::INT + t2::INT) AS ap, avg((t1 = p1 AND t2 = p2)::INT) AS exact FROM s)
SELECT round(tp / pp, 6) AS precision, round(tp / ap, 6) AS recall, round(2 * tp / (pp + ap), 6) AS f1, round(exact, 6) AS exact FROM c""")
def micro_prf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels with scores from the ids."""
    rows = table(spark, sf_dir, "labels").select("quality", "toxic", (F.col("doc_id") % 10 / 10).alias("s1"), (F.col("doc_id") % 7 / 7).alias("s2"))
    return metrics.multi_label(rows, ["quality", "toxic"], ["s1", "s2"])


@register("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919 + 42) % 10007, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS fold FROM k""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each label."""
    return selection.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality")


@register("SELECT doc_id, CASE WHEN (doc_id * 7919 + 42) % 10007 < 0.2 * 10007 THEN 'test' ELSE 'train' END AS fold FROM labels")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return selection.random_split(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@register("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each key."""
    return profiles.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("SELECT event_type, count(DISTINCT user_id) AS topics, count(*) AS questions, round(count(*) / count(DISTINCT user_id), 6) AS per_topic FROM events GROUP BY 1")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and entries of each subject."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("topics"), F.count("*").alias("questions"))
    return rows.withColumn("per_topic", F.round(F.col("questions") / F.col("topics"), 6))


@register("""WITH y AS (SELECT o_custkey, max(year(o_orderdate)) - min(year(o_orderdate)) AS years FROM orders GROUP BY 1)
SELECT o_custkey, years::INT AS years, CASE WHEN years < 2 THEN 'Junior' WHEN years < 5 THEN 'Mid' ELSE 'Senior' END AS level FROM y""")
def experience_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last year less first, and the level by a band table; the two ways to the level agree."""
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate"))).alias("years"))
    bands = spark.createDataFrame(D.EXPERIENCE_LEVELS, "name string, low double, high double")
    joined = matching.band_join(years, "years", bands)
    return joined.filter(F.col("name") == experience_level(F.col("years"))).select("o_custkey", "years", F.col("name").alias("level"))


@register("""WITH s AS (SELECT doc_id, {'definition': (doc_id * 37 % 100) / 100, 'explanation': (doc_id * 53 % 100) / 100, 'comparison': (doc_id * 71 % 100) / 100} AS m, quality FROM labels)
SELECT doc_id, CASE WHEN m.definition >= m.explanation AND m.definition >= m.comparison THEN 'definition' WHEN m.explanation >= m.comparison THEN 'explanation' ELSE 'comparison' END AS best,
  array_to_string(list_transform(list_sort([struct_pack(s := -m.definition, k := 'definition'), struct_pack(s := -m.explanation, k := 'explanation'), struct_pack(s := -m.comparison, k := 'comparison')]), lambda e: e.k), '>') AS ranked,
  quality::BIGINT AS quality_id, CASE quality WHEN 1 THEN '01' ELSE '10' END AS hot, round(1 / (1 + exp(-m.definition)), 6) AS sigmoid,
  round(exp(m.definition) / (exp(m.definition) + exp(m.explanation) + exp(m.comparison)), 6) AS softmax FROM s""")
def label_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arg-max, ordering, one-hot and index encodings, softmax and sigmoid."""
    names = D.INTENTS[:3]
    primes = dict(zip(names, (37, 53, 71)))
    m = F.create_map(*[v for t in names for v in (F.lit(t), (F.col("doc_id") * primes[t] % 100) / 100)])
    rows = table(spark, sf_dir, "labels").withColumn("m", m)
    grade = F.when(F.col("quality") == 1, "good").otherwise("bad")
    hot = F.transform(multi_hot(F.array(grade), ["bad", "good"]), lambda x: x.cast("int").cast("string"))
    return rows.select(
        "doc_id",
        top_label(F.col("m"), names).alias("best"),
        F.array_join(F.transform(by_score(F.col("m")), lambda e: e["label"]), ">").alias("ranked"),
        label_index(grade, ["bad", "good"]).alias("quality_id"),
        F.array_join(hot, "").alias("hot"),
        F.round(sigmoid(F.element_at("m", names[0])), 6).alias("sigmoid"),
        F.round(F.get(softmax(F.map_values("m")), 0), 6).alias("softmax"),
    )


@register("""WITH s AS (SELECT o_orderkey, (o_orderkey * 37 % 101) / 100 AS sim, (o_orderkey * 53 % 101) / 100 AS con, (o_orderkey * 71 % 101) / 100 AS ent, o_orderkey % 60 AS n FROM orders)
SELECT o_orderkey, round(greatest(0, least(1, CASE WHEN n < 5 THEN 0.5 * 0.2 WHEN con > 0.6 THEN 0.1 + 0.5 * 0.2 WHEN sim > 0.9 AND ent > 0.8 THEN 0.9 + 0.5 * 0.1 ELSE sim * 0.6 + ent * 0.4 END)), 3) AS label FROM s""")
def grader_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of synthetic grading rows, with every draw at its middle."""
    k = F.col("o_orderkey")
    label = S.grader_label(k % 60, k * 53 % 101 / 100, k * 71 % 101 / 100, k * 37 % 101 / 100, F.lit(0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@register()
def meta_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest trained on four fifths of the labelled grading rows, and its score of the others."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, (k * 37 % 101 / 100).alias("similarity"), (k * 53 % 101 / 100).alias("contradiction"), (k * 71 % 101 / 100).alias("entailment"), (k % 60).alias("n_words"))
    rows = rows.withColumn("label", S.grader_label(F.col("n_words"), F.col("contradiction"), F.col("entailment"), F.col("similarity"), F.lit(0.5)))
    rows = selection.random_split(rows, "o_orderkey")
    model = grading.train_grader(rows.filter("fold = 'train'"))
    return grading.grade(model, rows.filter("fold = 'test'")).select("o_orderkey", "label", "predicted")


@register()
def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 seeded rows (Spark's generator; rows only)."""
    return selection.synthetic_rows(spark)
