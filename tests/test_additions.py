"""Sections, Word files, uploads, model inputs, carried totals, adaptive difficulty and sinks."""

import datetime as dt
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import extract as X
from tallyloom.functions import scoring as S
from tallyloom.functions.dictionaries import SECTION_HEADERS
from tallyloom.operators import encoding, matching, profiles, selection
from tallyloom.sources import io

ATTEMPTS = "user_id long, seq long, ts timestamp_ntz, score double, topic string, intent string, difficulty string"


def plain_sections(text):
    out, now = {n: "" for n in [*SECTION_HEADERS, "other"]}, "other"
    for line in text.split("\n"):
        head = next((n for n, heads in SECTION_HEADERS.items() if re.search("|".join(heads), line.upper().strip(" \t\r\n"))), None)
        if head:
            now = head
        elif line.strip():
            out[now] += line + "\n"
    return out


def test_sections_equal_a_plain_loop(spark):
    rng = random.Random(2)
    lines = ["EDUCATION", "Work Experience:", "skills", "", "  ", "a line", "another one of them", "SUMMARY", "Skills and tools", "x"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["\n".join(["line %d" % i for i in range(20_000)] + ["SKILLS", "sql"])]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, x string")
    got = {r.id: r.s for r in rows.select("id", X.sections(F.col("x")).alias("s")).collect()}
    assert got.pop(-1) is None
    assert got == {i: plain_sections(t) for i, t in enumerate(texts)}


def word_file(path, paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{''.join(f'<w:r>{run}</w:r>' for run in p)}</w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}{table}</w:body></w:document>')


def test_word_files_and_uploads(spark, tmp_path):
    word_file(tmp_path / "cv.docx", [["<w:t>Jane </w:t>", "<w:t>Doe</w:t>"], [], ["<w:t>jane@example.org</w:t><w:tab/><w:t>SQL</w:t>"]])
    (tmp_path / "b.ats").write_text("SKILLS\nscala\n")
    (tmp_path / "c.rtf").write_text("not read")
    got = {r.format: r for r in io.read_resumes(spark, str(tmp_path)).collect()}
    assert set(got) == {"DOCX", "ATS"}
    assert (got["DOCX"].raw_text, got["DOCX"].email, got["DOCX"].sections) == ("Jane Doe jane@example.org SQL", "jane@example.org", None)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.docx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        io.read_resumes(spark, str(tmp_path / "bad")).collect()
    rows = [("a.pdf", 10, "x" * 50, True), ("a.PDF", 10 * 1024 * 1024, " " + "x" * 50, True), ("a.docx", 10 * 1024 * 1024 + 1, "x" * 50, False), ("a.txt", 1, "x" * 50, False), ("a.docx", 1, "x" * 49 + "  ", False)]
    got = spark.createDataFrame(rows, "name string, size long, text string, ok boolean").select(io.upload_ok().alias("found"), "ok").collect()
    assert all(r.found == r.ok for r in got)


def test_padded_ids(spark):
    names = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = names.path("word_bpe_49k.json")
    texts = ["a tree keeps order", None, "", "word " * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    got = {r.id: r for r in encoding.padded_ids(rows, path, "id", first_id=49406, last_id=49407).collect()}
    for i, text in enumerate(texts):
        ids = [49406, *Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids[:62], 49407]
        assert got[i].input_ids == ids + [0] * (64 - len(ids)) and got[i].attention_mask == [1] * len(ids) + [0] * (64 - len(ids))
    assert encoding.padded_ids(rows.limit(0), path, "id").count() == 0


def test_running_totals_equal_a_plain_loop(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 2, None]), i, None if i % 50 == 0 else start + dt.timedelta(hours=rng.randrange(400)), rng.randrange(0, 1001) / 10, "OS", "definition", "easy") for i in range(400)]
    got = {(r.user_id, r.seq): r for r in profiles.running_level(spark.createDataFrame(rows, ATTEMPTS).repartition(4)).collect()}
    assert len(got) == len(rows)
    for user in (1, 2, None):
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2] is not None, r[2] or start, r[1]))
        total = 0
        for n, r in enumerate(own, 1):
            total += round(r[3] * 10)
            assert got[user, r[1]].attempted == n and got[user, r[1]].accuracy == pytest.approx(total / 10 / n, abs=1e-6)


def test_adaptive_difficulty(spark):
    bank = spark.createDataFrame([(i, "OS", d, "definition") for i, d in enumerate(["easy", "medium", "hard"])], "question_id long, topic string, difficulty string, intent string")
    # Users by strategy: the draw of 1 is weak_topic.
    user = next(u for u in range(200) if (u * 7919 + 104_729) % 100 < 60)
    other = next(u for u in range(200) if (u * 7919 + 104_729) % 100 >= 90)
    rows = [(user, ["OS"], [], "hard", {"OS": 39.9}), (other, ["OS"], [], "hard", {"OS": 39.9})]
    learners = spark.createDataFrame(rows, "user_id long, weak_topics array<string>, weak_intents array<string>, target string, accuracy map<string,double>")
    got = {r.user_id: (r.strategy, r.target, r.question_id) for r in selection.adaptive_choice(learners, bank).collect()}
    assert got == {user: ("weak_topic", "easy", 0), other: ("random", "hard", 2)}
    row = spark.createDataFrame([("hard", 40.0), ("hard", 39.9), ("medium", None)], "t string, a double")
    assert [r[0] for r in row.select(S.adaptive_difficulty(F.col("t"), F.col("a"))).collect()] == ["hard", "easy", "medium"]


def test_recommendation(spark):
    row = spark.createDataFrame([(["OS", "CN"], "beginner"), ([], "advanced")], "w array<string>, l string")
    assert [r[0] for r in row.select(S.recommendation(F.col("w"), F.col("l"))).collect()] == [
        "Focus on OS, CN to improve. You're at beginner level.",
        "Great progress! You're at advanced level. Try more challenging questions.",
    ]


def test_domains_ride_along_in_one_row(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)], i % 3) for i in range(12)], "vec_id long, embedding array<float>, label int")
    got = matching.domain_ensemble(rows, matching.centroids(rows))
    assert all(r.domain == r.vec_id % 3 for r in got.collect())
    assert "Exchange hashpartitioning(vec_id" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "DOMAINS", 2)
    with pytest.raises(ValueError, match="domains"):
        matching.domain_ensemble(rows, matching.centroids(rows))


def test_report_and_labels(spark, tmp_path):
    line = S.report_lines(F.lit("q"), F.lit("a  b"), F.lit(1.5), F.lit("F")).alias("line")
    io.write_report(spark.range(1).select(line), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["Q: q", "A: a b", "Score: 1.5", "Grade: F", "-" * 60]
    io.write_json(io.label_metadata(spark, ["easy", "hard"]), str(tmp_path / "l"))
    assert sorted(map(tuple, spark.read.schema("id int, label string").json(str(tmp_path / "l")).collect())) == [(0, "easy"), (1, "hard")]
    rows = [(1, 'says "no", twice'), (2, "two\nlines  "), (3, None), (4, "a\\b")]
    io.write_csv(spark.createDataFrame(rows, "id int, text string"), str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), "id int, text string").collect())) == rows


def test_sides_without_an_equal_key_go_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    vectors = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(60)], "vec_id long, embedding array<float>")
    words = "tree graph stack queue heap node edge path root leaf".split()
    bank = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(40)], "pos long, pattern string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(30)], "question_id long, text string")

    def results():
        return sorted(map(str, matching.nearest(vectors.filter("vec_id < 20"), vectors, 4).collect())), sorted(map(str, matching.bank_match(asked, bank).collect()))

    whole = results()
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 7)
    assert len(matching.blocks(bank, "pos")) == 6 and results() == whole
    assert "CartesianProduct" not in matching.nearest(vectors, vectors, 2)._jdf.queryExecution().executedPlan().toString()
