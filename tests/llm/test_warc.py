import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import warc as W

PAGES = [(i, f"http://h.example/{i}", f"<p>page {i}</p>" * (i % 90 + 1)) for i in range(200)]
PAGES += [(300 + i, f"http://c.example/{i}", "<p>the same</p>" * 100) for i in range(40)]
PAGES += [(400, None, None), (401, "http://x.example/a b\r\nEvil: 1", ""), (402, "u", "é" * 700), (403, "v", "é" * 700), (None, "n", "é" * 700), (404, "s", "tiny"), (405, "s", "tiny")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(5)


def test_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/a"
    manifest = W.write_warc(pages, path, roll_bytes=3000, shard_bytes=40_000)
    assert manifest.count() > 5 and max(r.records for r in manifest.collect()) > 1
    got = {r.page_id: r for r in W.read_warc(spark, path, with_html=True).collect()}
    assert len(got) == len(PAGES)
    keeper = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 1000:
            keeper[raw] = max(keeper.get(raw, -1), i)
    for i, url, html in PAGES:
        r = got[None if i is None else str(i)]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = raw in keeper and keeper[raw] != i
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (str(keeper[raw]) if revisit else None)
        assert r.html == ("" if revisit else html or "")
    assert not list((tmp_path / "a").glob("_temporary*"))


def test_same_rows_same_bytes(spark, pages, tmp_path):
    for name, own in (("a", pages), ("b", pages.repartition(2))):
        W.write_warc(own, f"file://{tmp_path}/{name}", roll_bytes=5000, shard_bytes=40_000)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab")
    assert a == b and len(a) > 1
    head = gzip.decompress(min(a.items())[1]).split(b"\r\n")[:2]
    assert head == [b"WARC/1.1", b"WARC-Type: warcinfo"]


def test_decisions_that_outgrow_a_broadcast(spark, pages, tmp_path):
    more = pages.union(spark.createDataFrame([(402, "again", "é" * 700), (403, "again", "é" * 700), (None, None, "é" * 700), (None, "n", "<p>the same</p>" * 100)], pages.schema))
    for name, own in (("a", {}), ("b", {"max_broadcast_groups": 0})):
        W.write_warc(more, f"file://{tmp_path}/{name}", roll_bytes=5000, shard_bytes=40_000, **own)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab")
    assert a == b and len(a) > 1
    assert sum(r.record_type == "revisit" for r in W.read_warc(spark, f"file://{tmp_path}/b").collect()) == 39 + 5


def test_html_takes_part_in_no_join(spark):
    own = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    keys = W.written(own.select("page_id", F.lit(None).cast("string").alias("url"), "size", "digest"), "keys")
    rows = W.classified(own, keys, W.repeated(keys), broadcast=False).repartitionById(4, F.lit(0))
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    exchanges = [block.split("Arguments:")[0] for block in plan.split("\n\n") if ") Exchange" in block.split("\n")[0]]
    assert sum("html" in e for e in exchanges) == 1
    assert not any("html" in block for block in plan.split("\n\n") if "Join" in block.split("\n")[0])


def test_changed_files_are_found_out(spark, pages, tmp_path):
    path = f"file://{tmp_path}/a"
    W.write_warc(pages, path)
    first = sorted((tmp_path / "a").glob("*.warc.gz"))[0]
    first.write_bytes(first.read_bytes()[:-1] + b"x")
    with pytest.raises(Exception, match="not what the manifest lists"):
        W.read_warc(spark, path).count()
    with pytest.raises(FileNotFoundError):
        W.read_warc(spark, f"file://{tmp_path}/none")


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_warc(spark, path).count() == 0


def test_columns_of_any_name_and_a_path_without_a_scheme(spark, pages, tmp_path):
    clashing = pages.select("*", *[pages["page_id"].cast("string").alias(c) for c in ("size", "digest", "shard", "file", "value", "refers.to")])
    W.write_warc(clashing, f"{tmp_path}/a", shard_bytes=40_000)
    W.write_warc(clashing, f"{tmp_path}/a", shard_bytes=40_000)  # once more over it
    W.write_warc(pages, f"file://{tmp_path}/b", shard_bytes=40_000)
    a, b = (sorted(map(tuple, W.read_warc(spark, f"{tmp_path}/{n}").fillna("").collect())) for n in "ab")
    assert a == b and len(a) == len(PAGES)
    assert {p.name for p in (tmp_path / "a").glob("*.warc.gz")} == {r.file for r in spark.read.parquet(f"{tmp_path}/a/manifest").collect()}


def test_files_are_gzip_members_a_record_each(spark, pages, tmp_path):
    W.write_warc(pages, f"file://{tmp_path}/a", roll_bytes=20_000)
    for file in (tmp_path / "a").glob("*.warc.gz"):
        raw, n = file.read_bytes(), 0
        while raw:
            member = zlib.decompressobj(31)
            text = member.decompress(raw)
            raw, n = member.unused_data, n + 1
            assert member.eof and (text.startswith(b"WARC/1.1") or not raw and not text)
        assert n > 2


def test_ids_of_text(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i:03d}", "u", "<p>x</p>" * i) for i in range(90)] + [(None, "u", "y")], "page_id string, url string, html string")
    W.write_warc(rows, f"file://{tmp_path}/a", shard_bytes=9_000)
    got = W.read_warc(spark, f"file://{tmp_path}/a").collect()
    assert sorted(r.page_id or "" for r in got) == sorted([""] + [f"p{i:03d}" for i in range(90)])
