import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import phrases, semantics
from tallyloom.plans import stages as W
from tallyloom.sources import io


@pytest.mark.parametrize("diversity", [0.0, 0.3, 0.7])
def test_picked_equals_a_plain_greedy_loop(diversity):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    relevance, alike = v @ v[0], v @ v.T
    want = []
    while len(want) < 12:
        best = None
        for i in range(40):
            if i not in want:
                score = round(relevance[i], 9) if not want else round((1 - diversity) * relevance[i] - diversity * max(alike[j, i] for j in want), 9)
                if best is None or score > best[0]:
                    best = (score, i)
        want.append(best[1])
    assert phrases.picked(relevance, alike, 12, diversity) == want
    assert sorted(phrases.picked(relevance[:3], alike[:3, :3], 12, diversity)) == [0, 1, 2] and phrases.picked(relevance[:0], alike[:0, :0], 12, diversity) == []


def test_diverse_phrases(spark):
    texts = ["the tree and the heap: tree heap tree", "tcp udp packet route tcp", None, "", "the of and", "sql " * 900 + "late"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = semantics.fit(rows, io.kept, size=6, buckets=128)
    got = {}
    for r in phrases.diverse_phrases(rows, model, most=4).collect():
        got.setdefault(r.id, {})[r.place] = (r.phrase, r.relevance)
    assert set(got) == {0, 1, 5} and all(sorted(p) == list(range(1, len(p) + 1)) for p in got.values())
    assert {p for p, _ in got[0].values()} <= {"tree", "heap", "tree heap", "heap tree"} and {p for p, _ in got[5].values()} == {"sql", "sql sql"}
    # Most relevant first: against the vectors that ``embed`` gives.
    whole = {r.i: np.array(r.vector) for r in semantics.embed(model, rows.select(F.col("doc_id").alias("i"), F.array_join(phrases.content_words(F.col("text")), " ").alias("text"))).collect()}
    part = semantics.embed(model, spark.createDataFrame([(got[1][1][0],)], "text string")).first().vector
    assert got[1][1][1] == pytest.approx(float(np.array(part) @ whole[1]), abs=1e-6)


class Broken(Exception):
    pass


def steps(spark, calls, broken=None, version="1"):
    def make(name, rows):
        calls.append(name)
        if name == broken:
            raise Broken(name)
        return rows

    return [
        W.Stage("a", lambda _: make("a", spark.range(10).withColumn("x", F.col("id") * 2)), metrics={"top": F.max("x")}),
        W.Stage("b", lambda done: make("b", done["a"].filter("x > 6")), version),
        W.Stage("c", lambda done: make("c", done["b"].join(done["a"], "id").select("id"))),
    ]


@pytest.mark.parametrize("broken", ["a", "b", "c"])
def test_a_run_broken_after_any_stage_gives_the_same_rows(spark, tmp_path, broken):
    calls, path = [], str(tmp_path / "run")
    with pytest.raises(Broken):
        W.run(spark, path, steps(spark, calls, broken))
    before = len(calls)
    rows = W.run(spark, path, steps(spark, calls))
    assert [r.id for r in rows["c"].orderBy("id").collect()] == list(range(4, 10))
    assert calls[before:] == ["a", "b", "c"][["a", "b", "c"].index(broken) :]
    assert W.run(spark, path, steps(spark, calls))["c"].count() == 6 and len(calls) == before + len(calls[before:])


def test_markers_metrics_and_versions(spark, tmp_path):
    calls, path = [], str(tmp_path / "run")
    W.run(spark, path, steps(spark, calls))
    done = W.finished(spark, path)
    assert {n: s["metrics"]["rows"] for n, s in done.items()} == {"a": 10, "b": 6, "c": 6} and done["a"]["metrics"]["top"] == 18
    W.run(spark, path, steps(spark, calls, version="2"))
    assert calls == ["a", "b", "c", "b", "c"] and W.finished(spark, path)["b"]["version"] == "2"
    assert json.loads((tmp_path / "run" / "done" / "a.json").read_text())["folder"] == done["a"]["folder"]


def test_rows_of_a_stage_that_broke_while_writing_are_not_read(spark, tmp_path):
    path = str(tmp_path / "run")
    bad = W.Stage("a", lambda _: spark.range(5).withColumn("x", F.raise_error(F.lit("broken"))).withColumn("x", F.col("x").cast("string")))
    with pytest.raises(Exception, match="broken"):
        W.run(spark, path, [bad])
    assert W.finished(spark, path) == {}
    assert W.run(spark, path, [W.Stage("a", lambda _: spark.range(5))])["a"].count() == 5
