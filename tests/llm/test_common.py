import pyarrow as pa

from tallyloom.llm import common as C


def test_small_batches_are_bounded_by_rows_and_bytes():
    texts = ["a" * 10, None, "b" * 50, "", "c" * 7, "é" * 20, "d"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"]).slice(2)
    for rows, size in ((3, 1000), (100, 25), (2, 8), (1, 1)):
        got = list(C.small_batches([batch, batch.slice(0, 0)], rows, size))
        assert [t for b in got for t in b.column("text").to_pylist()] == texts[2:]
        assert all(b.num_rows <= rows and (b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= size) for b in got)
    assert [b.num_rows for b in C.small_batches([batch.select(["id"])], 50)] == [50, 11]


def test_prefix_and_names(spark):
    assert C.free_prefix(["a", "NEW_x", "new__y"]) == "new___"
    row = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int").select(C.named("a.b").alias("x"), C.named("c`d").alias("y")).first()
    assert tuple(row) == (1, 2)


def test_scratch_goes(spark):
    with C.scratch_scope(spark):
        path = C.scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        kept = C.written(spark.range(2), "y").inputFiles()
    fs, make = C.hadoop(spark, path)
    assert not fs.exists(make(path)) and not fs.exists(make(kept[0]))
    assert fs.exists(make(path).getParent())
