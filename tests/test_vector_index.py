import pytest
from pyspark.sql import functions as F

from tallyloom.operators import matching
from tallyloom.operators import vector_index as V

ROWS = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.fixture(scope="module", params=["l2", "cosine"])
def stored(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    V.write_index(spark.read.parquet(ROWS), path, request.param, keep=("label",))
    return request.param, path


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("probes", [1, 8])
def test_exact_search_equals_all_vectors(spark, stored, probes):
    by, path = stored
    vectors = spark.read.parquet(ROWS)
    queries = vectors.filter("vec_id % 100 = 0")
    assert rows(V.search(spark, path, queries, 5, probes, exact=True)) == rows(matching.nearest(queries, vectors, 5, by))


def test_recall_and_what_is_read(spark, stored):
    by, path = stored
    vectors = spark.read.parquet(ROWS)
    queries = vectors.filter("vec_id % 100 = 0")
    want = {r[:1] + r[2:3] for r in rows(matching.nearest(queries, vectors, 5, by))}
    got = {r[:1] + r[2:3] for r in rows(V.search(spark, path, queries))}
    assert len(want & got) / len(want) >= 0.9
    one = queries.limit(1)
    assert 0 < V.read_share(spark, path, one, 2) < 0.25 < 0.99 < V.read_share(spark, path, queries, 1000)
    assert V.read_share(spark, path, one) < 0.9  # vectors of this table are all but uniform


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    x = F.array(*[F.when(F.col("id") % 50 == i, 5.0).otherwise(0.0) + F.rand(i) for i in range(50)])
    spark.range(5000).select(F.col("id").alias("vec_id"), x.alias("embedding")).write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    V.write_index(vectors, str(tmp_path / "i"), cells=50)
    queries = vectors.filter("vec_id % 100 = 7")
    want = {r[:1] + r[2:3] for r in rows(matching.nearest(queries, vectors, 5))}
    got = {r[:1] + r[2:3] for r in rows(V.search(spark, str(tmp_path / "i"), queries))}
    assert len(want & got) / len(want) >= 0.9
    assert V.read_share(spark, str(tmp_path / "i"), queries.limit(1)) < 0.15


def test_other_cells_are_pruned(spark, stored):
    _, path = stored
    cells = spark.createDataFrame([(0,), (0,)], "cell int")
    found = V.probed(spark, path, cells)
    assert found.select("cell").distinct().collect()[0].cell == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan
    every = spark.read.parquet(f"{path}/vectors")
    assert every.count() == spark.read.parquet(ROWS).count() and every.columns == ["vec_id", "embedding", "label", "cell"]


@pytest.mark.parametrize("by", ["l2", "cosine"])
def test_ties_zeros_nulls_and_few_rows(spark, tmp_path, by):
    data = [(i, [float(i % 3), 1.0 if i % 5 else 0.0]) for i in range(30)] + [(40, [0.0, 0.0]), (41, None), (42, [])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    V.write_index(vectors, str(tmp_path / "i"), by, cells=4)
    usable = vectors.filter(F.size("embedding") > 0)
    asked = usable.filter("vec_id < 4 or vec_id = 40")
    assert rows(V.search(spark, str(tmp_path / "i"), asked, 7, 1, exact=True)) == rows(matching.nearest(asked, usable, 7, by))
    assert V.search(spark, str(tmp_path / "i"), vectors.filter("vec_id = 41")).count() == 0
    V.write_index(vectors.limit(0), str(tmp_path / "none"), by)
    assert V.search(spark, str(tmp_path / "none"), asked).count() == 0
    V.write_index(vectors.filter("vec_id = 3"), str(tmp_path / "one"), by)
    assert [r.vec_id for r in V.search(spark, str(tmp_path / "one"), vectors.filter("vec_id = 1")).collect()] == [3]
