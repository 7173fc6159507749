import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import matching, metrics, profiles, selection
from tallyloom.sources import io
from tallyloom.streaming import profiles as stream

SCHEMA = "user_id long, seq long, ts timestamp_ntz, score double, topic string, intent string, difficulty string"


def attempts(spark, scores, per_day=100):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(days=i // per_day, minutes=i), float(s), "OS", "definition", "easy") for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, SCHEMA)


def replay(scores, per_day):
    """Target difficulty step by step."""
    target, total = "easy", 0.0
    for i, s in enumerate(scores):
        total += s
        n, acc = i + 1, round(total / (i + 1), 6)
        if n < 3:
            target = "easy"
        elif acc < 50 and target != "easy":
            target = "easy"
        elif acc >= 85 and target == "medium" and n >= 8:
            target = "hard"
        day = scores[i // per_day * per_day : (i // per_day + 1) * per_day]
        if (n % per_day == 0 or n == len(scores)) and len(day) >= 5 and sum(day) / len(day) >= 80 and target == "easy":
            target = "medium"
    return target


@pytest.mark.parametrize("scores, per_day", [([90] * 4, 5), ([90] * 5, 5), ([90] * 12, 6), ([90] * 12 + [0] * 14, 6), ([80] * 6 + [95] * 40, 6), ([0] * 3, 2), ([100] * 1100, 600)])
def test_fold_equals_replay(spark, scores, per_day):
    row = profiles.target_difficulty(attempts(spark, scores, per_day)).first()
    assert (row.attempted, row.target) == (len(scores), replay(scores, per_day))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0, 40, 85, 100]), min_size=1, max_size=40), st.integers(5, 9))
def test_fold_of_any_history(spark, scores, per_day):
    assert profiles.target_difficulty(attempts(spark, scores, per_day)).first().target == replay(scores, per_day)


def test_accuracy_does_not_depend_on_order(spark):
    rows = attempts(spark, [0, 60, 59.9, 100])
    a = profiles.topic_accuracy(rows).collect()
    assert a == profiles.topic_accuracy(rows.orderBy(F.desc("seq"))).collect()
    assert (a[0].attempted, a[0].accuracy, a[0].easy_correct, a[0].strength) == (4, 54.975, 2, "weak")


def test_weak_topics_need_three_attempts_and_have_a_default(spark):
    assert profiles.weak_topics(attempts(spark, [0, 0])).first().weak_topics == "DSA,OS"
    assert profiles.weak_topics(attempts(spark, [0, 0, 0])).first().weak_topics == "OS"
    assert profiles.strong_topics(attempts(spark, [90] * 3)).first().strong_topics == "OS"
    assert profiles.weak_intents(attempts(spark, [0, 90])).first().weak_intents == "definition"


BANK = [(i, "t", "OS" if i < 3 else "CN", ["easy", "medium", "hard"][i % 3], "definition") for i in range(6)]


def test_next_question_relaxes_then_completes(spark):
    bank = spark.createDataFrame(BANK, "question_id long, text string, topic string, difficulty string, intent string")
    learners = spark.createDataFrame([(1, []), (2, [1]), (3, list(range(6)))], "user_id long, asked array<long>")
    got = {r.user_id: r for r in selection.next_questions(learners, bank, "medium", "OS").collect()}
    assert (got[1].status, got[1].question_id) == ("success", 1)
    assert (got[2].status, got[2].candidates) == ("relaxed", 5)
    assert (got[3].status, got[3].question_id) == ("completed", None)


def test_bank_match(spark):
    bank = spark.createDataFrame([(0, "What is a tree?"), (1, "binary search tree order"), (2, "what is a"), (3, "greedy")], "pos long, pattern string")
    asked = spark.createDataFrame([(1, "what is a TREE"), (2, "so what is a graph"), (3, "order of search"), (4, "zzz"), (5, "greedy choice")], "question_id long, text string")
    got = {r.question_id: (r.how, r.pos) for r in matching.bank_match(asked, bank).collect()}
    assert got == {1: ("equal", 0), 2: ("contains", 2), 3: ("words", 1), 4: ("words", 1), 5: ("contains", 3)}


def test_nearest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(7)], "vec_id long, embedding array<float>")
    got = matching.nearest(rows.filter("vec_id = 0"), rows, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score, r.relevance) for r in got] == [(0, 0, 1), (3, 0, 1), (6, 0, 1)]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (2, 1)], "t int, p int")
    got = {r.label: r for r in metrics.report(rows, "t", "p").collect()}
    assert (got[1].precision, got[1].recall, got[1].f1, got[1].support) == (0.5, 0.5, 0.5, 2)
    assert (got[2].precision, got[2].recall, got[2].f1) == (0, 0, 0)
    single = metrics.single_label(rows, "t", "p").first()
    assert single.accuracy == 0.5 and single.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3, abs=1e-6)
    weights = {r.label: r.weight for r in metrics.class_weights(rows, "t", spark.createDataFrame([(0,), (1,), (2,), (3,)], "label int")).collect()}
    assert weights == {0: 1.0, 1: 0.5, 2: 1.0, 3: 1.0}


def test_splits(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(3000)], "id long, y int")
    got = selection.stratified_split(rows, "id", "y").groupBy("y", "fold").count().collect()
    assert {(r.y, r.fold): r["count"] for r in got} == {(y, f): n for y in range(3) for f, n in (("test", 200), ("train", 800))}
    assert 500 < selection.random_split(rows, "id").filter("fold = 'test'").count() < 700


def test_files(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text('[{"text": "What?", "intent": "definition", "difficulty": "easy", "topics": ["OS"]}]')
    assert io.read_questions(spark, str(q)).first().topics == ["OS"]
    assert io.read_questions(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_questions(spark, str(tmp_path / "none.json"), strict=True)
    (tmp_path / "topics.txt").write_text(" tcp \n\nudp\n")
    assert [r.topic for r in io.read_topics(spark, str(tmp_path / "topics.txt")).collect()] == ["tcp", "udp"]
    (tmp_path / "d.json").write_text('{"Law": "contracts", "Finance": "banks"}')
    assert {r.domain for r in io.read_domains(spark, str(tmp_path / "d.json")).collect()} == {"Law", "Finance"}
    (tmp_path / "cv").mkdir()
    (tmp_path / "cv" / "a.txt").write_bytes(b"Me\nSKILLS\nsql \xff a@b.co\n")
    row = io.read_resumes(spark, str(tmp_path / "cv")).first()
    assert (row.format, row.email) == ("ATS", "a@b.co") and row.sections["skills"].startswith("sql")
    flat = io.parse_resumes(spark.createDataFrame([("x.PDF", "a\nb")], "path string, text string")).first()
    assert (flat.format, flat.raw_text, flat.sections) == ("PDF", "a b", None)
    with pytest.raises(Exception, match="unsupported format"):
        io.parse_resumes(spark.createDataFrame([("x.rtf", "a")], "path string, text string")).collect()
    (tmp_path / "ix").mkdir()
    (tmp_path / "ix" / "os.index").write_bytes(b"x")
    assert [r.subject for r in io.subjects(spark, str(tmp_path / "ix")).collect()] == ["os"]


def test_profiles_and_cache(spark, tmp_path):
    path = str(tmp_path / "p")
    io.write_profiles(spark.createDataFrame([(1, 3), (2, 5)], "user_id long, total_attempted long"), path)
    assert io.read_profile(spark, path, 2).first().total_attempted == 5
    assert io.read_profile(spark, path, 9).count() == 0
    every = io.get_or_create(spark.createDataFrame([(1,), (7,)], "user_id long"), spark.read.json(path).drop("bucket"))
    assert {r.user_id: r.total_attempted for r in every.collect()} == {1: 3, 7: 0}
    schema = "subject string, topic string, questions array<string>, timestamp string"
    cache = io.upsert_cache(spark.createDataFrame([("s", "t", ["old"], "1"), ("s", "u", ["u"], "1")], schema), spark.createDataFrame([("s", "t", ["new"], "2")], schema))
    assert io.cached_questions(cache, "t", "s").first().questions == ["new"] and cache.count() == 2


def test_page_chunks_number_dropped_pages(spark):
    rows = spark.createDataFrame([(1, ["x" * 21, " " + "y" * 20, "z" * 30])], "doc long, pages array<string>")
    assert [(r.id, r.page) for r in io.page_chunks(rows).collect()] == [(0, 1), (2, 3)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), i, start + dt.timedelta(minutes=i), float(rng.randrange(101)), rng.choice(["OS", "CN"]), "definition", "easy") for i in range(120)]
    source = str(tmp_path / "in")
    batch = spark.createDataFrame(rows, SCHEMA.replace("timestamp_ntz", "timestamp"))
    batch.repartition(3).write.parquet(source)
    live = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.write_latest(stream.topic_stats(live), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "out"))
    last = profiles.latest(written, ["user_id", "topic"], ["batch"]).drop("batch")
    assert sorted(last.collect()) == sorted(stream.topic_stats(batch).collect())
    sessions = stream.session_scores(batch).collect()
    assert sum(s.answers for s in sessions) == 120


def test_index_and_resume(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = spark.createDataFrame([("os", 0, 1, [0.5]), ("cn", 1, 2, [0.1])], "subject string, pos int, page int, embedding array<float>")
    io.write_index(rows, path)
    assert io.read_index(spark, path, "os").first().page == 1 and io.read_index(spark, path, "db") is None
    assert [r.subject for r in io.unfinished(rows, rows.filter("pos = 0"), "subject").collect()] == ["cn"]
