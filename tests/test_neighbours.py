import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import matching, neighbours
from tallyloom.operators import vector_index as V


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def plain(queries, vectors, k, by):
    """An expression for each pair, by way of all of them."""
    from pyspark.sql import Window

    from tallyloom.functions.vectors import as_double, cosine, l2_squared

    q = queries.select(F.col("vec_id").alias("query_id"), as_double(F.col("embedding")).alias("q"))
    v = vectors.select("vec_id", as_double(F.col("embedding")).alias("v"))
    score = l2_squared(F.col("q"), F.col("v")) if by == "l2" else cosine(F.col("q"), F.col("v"))
    order = Window.partitionBy("query_id").orderBy(F.col("score") if by == "l2" else F.desc("score"), "vec_id")
    return q.crossJoin(v).withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@pytest.fixture(scope="module")
def crowded(spark):
    """Copies, near copies, vectors closer than rounding tells apart, zeros."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 8))[rng.integers(0, 40, 600)]
    x[100:300] = x[0]
    x[300:400] += rng.standard_normal((100, 8)) * 3e-4
    x[400:500] = rng.standard_normal((100, 8)) * 1e-4
    x[500] = 0
    data = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3).localCheckpoint()


@pytest.mark.parametrize("by", ["l2", "cosine"])
def test_equal_to_an_expression_for_each_pair(spark, crowded, monkeypatch, tmp_path, by):
    queries = crowded.filter("vec_id % 7 = 3 or vec_id in (0, 500)")
    want = rows(plain(queries, crowded, 5, by))
    assert rows(matching.nearest(queries, crowded, 5, by)) == want
    monkeypatch.setattr(neighbours, "PIECE_QUERIES", 16)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(neighbours.blocks, "__defaults__", (2000,))
    assert len(list(neighbours.blocks(queries.withColumnRenamed("vec_id", "query_id")))) > 2
    assert rows(matching.nearest(queries, crowded, 5, by)) == want
    V.write_index(crowded, str(tmp_path / "i"), by, cells=6)
    assert rows(V.search(spark, str(tmp_path / "i"), queries, 5, exact=True)) == want


def test_no_pair_is_a_row_of_the_plan(spark, crowded, tmp_path):
    queries = crowded.filter("vec_id % 100 = 0")
    V.write_index(crowded, str(tmp_path / "i"), cells=4)
    plan = V.search(spark, str(tmp_path / "i"), queries, exact=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    found = next(neighbours.blocks(queries.withColumnRenamed("vec_id", "query_id")))
    assert neighbours.best(crowded, found, 5, "l2").count() <= 6 * 5 * 4 * crowded.rdd.getNumPartitions()


@pytest.mark.parametrize("by", ["l2", "cosine"])
def test_rows_without_a_vector_come_last(spark, by):
    data = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, []), (5, None)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(matching.nearest(vectors.filter("vec_id < 3"), vectors, 3, by))
    first, far = (0.0, 2.0) if by == "l2" else (1.0, 0.0)
    assert got == [(1, 1, 1, first), (1, 2, 3, far), (1, 3, 2, None), (2, 1, 1, None), (2, 2, 2, None), (2, 3, 3, None)]
    with pytest.raises(Exception, match="numbers each"):
        matching.nearest(vectors.filter("vec_id = 1"), spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), 3, by).collect()
