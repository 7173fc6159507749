from tallyloom.plans import stages, text_queries


def test_a_resume_is_folded_once_for_all_topics(spark, tiny):
    stage = text_queries.workflow_stages(spark, tiny)[0]
    plan = stage.make({})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_what_grows_with_the_resumes_is_not_broadcast(spark, tiny, tmp_path):
    n = 20_000
    spark.range(n).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 10), i -> md5(string(id * 100 + i))), ' ') AS text").write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "benchmark.parquet").symlink_to(f"{tiny}/benchmark.parquet")
    steps = text_queries.workflow_stages(spark, str(tmp_path))
    stages.run(spark, f"{tmp_path}/run", steps[:2])
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        got = stages.run(spark, f"{tmp_path}/run", steps)["sessions"].groupBy("answers").count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [tuple(r) for r in got] == [(3, n)]
