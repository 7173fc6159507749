import pytest
from pyspark.sql import functions as F

from tallyloom.functions import classify as C
from tallyloom.functions import extract as X
from tallyloom.functions import text as T


def each(spark, column, values):
    """The column function over values, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    assert each(spark, T.tok, ["", "  ", " a\tb\n\nc ", None]) == [[], [], ["a", "b", "c"], None]


def test_normal_forms(spark):
    assert each(spark, T.clean_text, ["a  b\né c http://x.y z ", ""]) == ["a b   c  z", ""]
    assert each(spark, T.clean_lines, ["a\né b"]) == ["a\n  b"]
    assert each(spark, T.fold_marks, ["What's B+ Tree?"]) == ["what s b tree"]
    assert each(spark, T.fold_case, ["  What   IS it "]) == ["what is it"]
    assert each(spark, lambda x: T.first_words(x, 2), ["a b c", "a"]) == ["a b", "a"]


@pytest.mark.parametrize("n, sizes", [(0, []), (2, [2]), (3, [3]), (4, [3, 1])])
def test_chunks(spark, n, sizes):
    got = each(spark, lambda x: T.word_chunks(x, 3), [" ".join("abcdefgh"[:n])])[0]
    assert [len(c.split()) for c in got] == sizes


def test_substring_matching_is_kept(spark):
    assert each(spark, lambda x: F.array_join(C.rule_topics(x), ","), ["explain osi", "the udp cost", "a description", "hello"]) == ["OS,CN", "OS,CN,DSA", "CN", "General"]


@pytest.mark.parametrize(
    "text, intent, difficulty, valid",
    [
        ("What is a process?", "definition", "easy", True),
        ("How would you build it", "procedure", "hard", True),
        ("Why not", "reasoning", "medium", True),
        ("explain it", "explanation", "medium", True),
        ("tell how does it work", "explanation", "medium", False),
        ("Compare x and y", "comparison", "medium", True),
        ("the difference", "comparison", "medium", False),
        ("a distributed thing", "explanation", "hard", False),
        ("", "explanation", "medium", False),
    ],
)
def test_rules(spark, text, intent, difficulty, valid):
    row = spark.createDataFrame([(text,)], "x string").select(C.rule_intent(F.col("x")), C.rule_difficulty(F.col("x")), C.is_question(F.col("x")), C.intent_result(F.col("x"))).first()
    assert tuple(row)[:3] == (intent, difficulty, valid)
    assert (row[3] is not None) == valid and (not valid or row[3].scores[intent] == 0.6)


def test_calibration_moves_scores(spark):
    def scores(**v):
        return F.create_map(*[c for k, x in v.items() for c in (F.lit(k), F.lit(x))])

    row = spark.createDataFrame([("What is the difference between a and b",)], "x string")
    got = row.select(C.calibrated_difficulty(scores(easy=0.8, medium=0.1, hard=0.1), F.col("x")).alias("m")).first().m
    assert sum(got.values()) == pytest.approx(1) and got["medium"] == pytest.approx(0.5 / 1.1)
    sure = row.select(C.calibrated_intent(scores(definition=0.9, explanation=0.1), F.col("x")).alias("m")).first().m
    assert sure == {"definition": 0.9, "explanation": 0.1}
    both = spark.createDataFrame([("class and array",)], "x string")
    m = scores(OS=0.1, DBMS=0.1, CN=0.1, OOP=0.1, DSA=0.1, General=0.1)
    assert set(both.select(C.selected_topics(m, F.col("x")).alias("t")).first().t) == {"DSA", "OOP"}


def test_extraction(spark):
    assert each(spark, X.email, ["x a.b-c@d.e.f, y@z.w", "none", ""]) == ["a.b-c@d.e.f", None, None]
    assert each(spark, X.phone, ["call +1 (555) 123-4567 now", "12345678", "123456789"]) == ["+1 (555) 123-4567", None, "123456789"]
    assert each(spark, X.dates, ["Mar. 2020, 1/2/2021, 1999 1999 and 123456"]) == [["1/2/2021", "1234", "1999", "Mar. 2020"]]
    years = each(spark, lambda x: X.year_range(x, 2024), ["none", "2020", "2020 - Present", "2018 to 2021", "1 2001 1999 2005"])
    assert [tuple(y) for y in years] == [(0, None, None), (0, None, None), (4, 2020, 2024), (3, 2018, 2021), (6, 1999, 2005)]


def test_sections(spark):
    got = each(spark, X.sections, ["hello\n\nWORK experience:\nx\n Skills and more\ny\nz\nEducation\n", ""])
    assert {k: v for k, v in got[0].items() if v} == {"other": "hello\n", "experience": "x\n", "skills": "y\nz\n"}
    assert not any(got[1].values())


RESUME = "Me\nEXPERIENCE\nEngineer\nNorth, Co\n2015 - 2018\n- Built it\n- Ran it\n\nAnalyst\nSouth\nJan 2019 - Present\nwrote many long reports.\n\nPrincipal\nWest\n2001 - 2009\n\nEDUCATION\nx"


def test_jobs(spark):
    jobs = each(spark, lambda x: X.job_experiences(x, 2024), [RESUME, RESUME.replace("\n", " "), ""])
    assert [(j.title, j.company, j.duration_years, j.start_year, j.end_year, j.primary_focus) for j in jobs[0]] == [
        ("Engineer", "North, Co", 3, 2015, 2018, "Built it - Ran it"),
        ("Analyst", "South", 5, 2019, 2024, "wrote many long reports. 2001 - 2009"),
    ]
    assert jobs[1:] == [[], []]
    total = each(spark, lambda x: X.total_experience(X.job_experiences(x, 2024)), [RESUME, ""])
    assert [tuple(t) for t in total] == [(9, "Senior"), (0, "Unknown")]


def test_html(spark):
    page = "<p>out</p><nav><p>menu</p></nav><script>var t='</p>'</script><!-- <p>no</p> --><div><p class=x>a <b>bold</b> &amp; c<p>second\nline</p>tail</div><footer><p>f</p></footer>"
    assert each(spark, X.html_paragraphs, [page, "", "<pre>x</pre>"]) == ["out a bold & c second line", "", ""]
    long = "<p>" + "the process and the thread " * 20 + "</p>"
    assert [len(x) for x in each(spark, X.page_text, [long, page])] == [539, 0]
