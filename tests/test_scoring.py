import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scoring as S
from tallyloom.functions.vectors import cosine, l2_squared, softmax


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "u, r, q, want",
    [
        ("one two three four five", "one two three", "", 0.99),
        ("one two three", "one two three", "", 0.6),
        ("one two x y z", "one two", "", 0.7),
        ("one x y z w", "one two", "", 0.5),
        ("a b c d e f g h i j k", "zz", "a b", 0.65),
        ("a b c d e f g h i j", "zz", "a b", 0.2),
        ("something", "zz", "", 0.12),
        (" ".join(f"w{i}" for i in range(51)), "w1 w2", "", 0.735),
        (" ".join(f"w{i}" for i in range(50)), "w1 w2", "", 0.7),
    ],
)
def test_lexical(spark, u, r, q, want):
    assert one(spark, S.lexical_score(F.col("u"), F.col("r"), F.col("q")), u=u, r=r, q=q) == pytest.approx(want)


@pytest.mark.parametrize("u, want", [("", 0), ("abcd", 0), ("abcde", 0.25), ("abcdefg", 0.25), ("abcdefgh", 0.12), ("the latest", 0), ("well idk then", 0)])
def test_gates(spark, u, want):
    assert one(spark, S.main_score(F.col("u"), F.lit("zz"), F.lit("")), u=u) == pytest.approx(want)


@pytest.mark.parametrize(
    "u, r, want",
    [("", "", 1), ("syn", "synchronize", 1), ("synchronize", "syn", 1), ("a tcp b", "tcp", 0.95), ("tcp", "a tcp b", 0.9), ("", "abc", 0.9), ("b a", "a b", 0.95), ("a b x", "y b a", 0.85), ("a x", "a y", 0)],
)
def test_fill(spark, u, r, want):
    assert one(spark, S.fill_score(F.col("u"), F.col("r")), u=u, r=r) == want


def test_documented_scenarios_follow_the_code(spark):
    """The weak answer comes to 0.354 and 4 marks, the good one to 0.993 and 10."""
    rows = spark.createDataFrame([(0.12, 0.9), (0.99, 1.0), (0.7, 0.85), (0.7, 0.0)], "m double, f double")
    got = rows.select(F.round(S.combined_score(F.col("m"), F.col("f")), 3), S.marks(F.col("m"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(0.354, 4), (0.993, 10), (0.745, 8), (0.49, 5)]


@pytest.mark.parametrize("x, grade, session", [(100.0, "A", "excellent"), (85.0, "A", "excellent"), (84.9, "A", "mostly_correct"), (80.0, "A", "mostly_correct"), (65.0, "C", "mostly_correct"), (59.9, "D", "partially_correct"), (49.9, "F", "partially_correct"), (39.9, "F", "blatantly_wrong"), (-1.0, "F", "blatantly_wrong")])
def test_bands(spark, x, grade, session):
    assert one(spark, F.concat_ws(",", S.letter_grade(F.col("x")), S.session_grade(F.col("x"))), x=x) == f"{grade},{session}"


@pytest.mark.parametrize("n, acc, strength, level", [(0, 0.0, "untested", "beginner"), (2, 99.0, "untested", "beginner"), (3, 59.9, "weak", "beginner"), (3, 60.0, "moderate", "beginner"), (5, 60.0, "moderate", "intermediate"), (5, 80.0, "strong", "advanced"), (8, 59.9, "weak", "beginner")])
def test_profile_bands(spark, n, acc, strength, level):
    assert one(spark, F.concat_ws(",", S.strength(F.col("n"), F.col("a")), S.level(F.col("n"), F.col("a"))), n=n, a=acc) == f"{strength},{level}"


@pytest.mark.parametrize("x, valid, coherent", [("", False, False), ("a", False, False), ("??", False, False), ("ab", True, False), ("it is so", True, True), ("f(x) is y", True, False), ("five words with no verb", True, True), ("f(x) of y and then z", True, True), ("éé", True, False)])
def test_answer_gates(spark, x, valid, coherent):
    assert one(spark, F.concat_ws(",", S.is_valid_answer(F.col("x")).cast("string"), S.is_coherent(F.col("x")).cast("string")), x=x) == f"{str(valid).lower()},{str(coherent).lower()}"


@pytest.mark.parametrize(
    "x, topics, found, want",
    [
        ("hello there", ["OS"], [], 8),
        ("it is x", ["OS"], [], 10),
        ("one two three four five", ["Zed"], [], 35),
        ("a thread is here", ["OOP"], [], 10),
        ("a thread is here", ["OS"], [], 45 + 15 / 17),
        ("a process thread uses memory", ["OS"], [], 75 + 20 * 3 / 17),
        ("a process thread uses memory", ["OS", "CN"], ["OS"], 89),
        ("the data is in a table", ["DBMS", "DSA"], [], 75 + 20 * 3 / 29),
    ],
)
def test_coverage(spark, x, topics, found, want):
    row = spark.createDataFrame([(x, topics, found)], "x string, t array<string>, f array<string>")
    assert row.select(S.topic_coverage(F.col("x"), F.col("t"), F.col("f"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(
    "n, intent, coverage, want",
    [(3, "definition", 10.0, 5), (10, "definition", 45.0, 55), (5, "explanation", 45.0, 35), (4, "reasoning", 45.0, 25), (30, "definition", 80.0, 100), (8, "definition", 80.0, 82), (2, "definition", 80.0, 50), (9, "comparison", 80.0, 40), (5, "other", 80.0, 70)],
)
def test_depth(spark, n, intent, coverage, want):
    assert one(spark, S.comprehensiveness(F.col("x"), F.col("i"), F.col("c")), x=" ".join(["zz"] * n), i=intent, c=coverage) == want


def test_depth_cues(spark):
    got = one(spark, S.comprehensiveness(F.col("x"), F.col("i"), F.lit(80.0)), x="it is unlike " + "zz " * 17, i="comparison")
    assert got == 95


def test_overall_and_bonus(spark):
    row = spark.createDataFrame([("the tree keeps order", "a tree keeps all keys in order")], "u string, m string")
    bonus = row.select(S.model_bonus(F.col("u"), F.col("m"))).first()[0]
    assert bonus == pytest.approx(3 / 5 * 40 + 4 / 7 * 30 + 3 / 5 * 30)
    got = row.select(S.overall_score(F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit(50.0)), S.overall_score(F.lit(70.0), F.lit(70.0), F.lit(70.0), F.lit(50.0))).first()
    assert tuple(got) == (100, 70)


@pytest.mark.parametrize("q, gate, points", [("What is a tree in the park?", True, 100), ("What is it?", False, 70), ("Generate a tree in the park?", False, 50), ("What is a tree in the park", False, 80), ("Discuss the tree in this park?", True, 75)])
def test_question_quality(spark, q, gate, points):
    assert one(spark, F.concat_ws(",", S.passes_gate(F.col("q")).cast("string"), S.quality_points(F.col("q")).cast("string")), q=q) == f"{str(gate).lower()},{points}"


@pytest.mark.parametrize("n, want", [(29, "No reference available"), (30, "x" * 30 + ".")])
def test_reference_guard(spark, n, want):
    assert one(spark, S.reference_answer(F.col("c")), c="x" * n) == want


def test_reference_answer(spark):
    assert one(spark, S.reference_answer(F.col("c")), c="One two three. Four five six. Seven eight. Nine.") == "One two three.  Four five six.  Seven eight."
    assert one(spark, S.reference_answer(F.col("c")), c="y" * 400) == "y" * 300 + "..."


def test_generated_questions(spark):
    context = "routers forward packets along the best known path each time"
    q = F.col("q")
    assert one(spark, S.kept_question(q, F.lit(context)), q="what?") == "Explain how routers forward packets works and why it is important in computer networks."
    assert one(spark, S.kept_question(q, F.lit(context)), q="How do the routers pick a path? yes.") == "How do the routers pick a path? yes?"
    assert one(spark, S.kept_question(q, F.lit("short")), q="x") == "Unable to generate question - insufficient context"
    assert one(spark, S.without_repetition(F.col("q")), q="a b. a c. a d.") == "a b.  a c."
    assert one(spark, S.web_question(q, F.lit(context)), q="generate it for me now please") == "What is routers and how does it work in computer systems?"


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z")), l2_squared(F.col("a"), F.col("b")), F.aggregate(softmax(F.col("b")), F.lit(0.0), lambda s, x: s + x)).first()
    assert tuple(got) == pytest.approx((2**-0.5, 0, 1, 1))
