"""A keyed table in buckets that is changed by merging batches: only touched buckets are written, and a batch counts once.

A version is a manifest that names, for each bucket, the folder that holds
its rows.  ``merge`` reads the buckets that a batch touches, combines old
and new rows, writes those buckets into a new folder and commits a manifest
in which all others keep theirs.  A manifest appears whole, by a rename that
fails if the version exists, so readers see one version or the next and of
two writers one is told to try again.  Each writer numbers its batches; the
manifest keeps the highest number of each, and a batch with a number that
is not higher changes nothing: a repeated micro-batch is harmless.

Layout: ``data/<folder>/bucket=<b>/*.parquet`` and
``manifest/<version>.json``.  ``vacuum`` removes folders that the last
versions do not name.

Scale: the driver holds one manifest (a line a bucket) and the touched
buckets' numbers.  Rows are read and written by Spark, one task a touched
bucket at the end, so ``buckets`` should grow with the table (it is fixed by
the first merge).

Defined results: a path without a manifest is an empty table; keys may be
null (they fall into a bucket like others); an empty batch commits its
number and writes nothing; a bucket that a merge leaves without rows goes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.profiles import latest

BUCKETS = 64
Combine = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer committed the version meanwhile; merge again."""


def keep_latest(keys: list[str], by: list[str]) -> Combine:
    """Of rows with equal keys the last in order of ``by`` stays."""
    return lambda rows: latest(rows, keys, by)


def add_up(keys: list[str], sums: list[str], least: tuple[str, ...] = ()) -> Combine:
    """Rows with equal keys become one with the sums, and the least values of ``least``; types stay."""

    def combine(rows: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        found = [F.sum(c).cast(kinds[c]).alias(c) for c in sums] + [F.min(c).alias(c) for c in least]
        return rows.groupBy(*keys).agg(*found)

    return combine


def files_of(spark: SparkSession, path: str) -> tuple:
    """(file system, maker of paths, file context) for a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(conf), make, jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), conf)


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, make, _ = files_of(spark, path)
    folder = make(f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """A version's manifest, the last one's by default; None for an empty table."""
    known = versions(spark, path)
    if not known:
        return None
    version = known[-1] if version is None else version
    lines = spark.read.text(f"{path}/manifest/{version:09d}.json", wholetext=True)
    return json.loads(lines.first()[0])


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    fs, make, context = files_of(spark, path)
    part = make(f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(part, make(f"{path}/manifest/{state['version']:09d}.json"), options)
    except Exception as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {state['version']} of {path} exists") from e
        raise


def bucket_of(keys: list[str] | list[Column], count: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def _stored(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    """Rows of some buckets, or of all; only their folders are read."""
    schema = StructType.fromJson(state["schema"])
    wanted = state["buckets"] if buckets is None else {b: f for b, f in state["buckets"].items() if int(b) in set(buckets)}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{folder}/bucket={b}" for b, folder in wanted.items()])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All rows of a version, the last by default; None if there is no version."""
    state = manifest(spark, path, version)
    return None if state is None else _stored(spark, path, state)


def lookup(spark: SparkSession, path: str, key: dict) -> DataFrame | None:
    """The rows of one key, read from its bucket alone; None if there is no version."""
    state = manifest(spark, path)
    if state is None:
        return None
    kinds = {f.name: f.dataType for f in StructType.fromJson(state["schema"]).fields}
    values = {k: F.lit(key[k]).cast(kinds[k]) for k in state["keys"]}
    bucket = spark.range(1).select(bucket_of(list(values.values()), state["count"])).first()[0]
    rows = _stored(spark, path, state, [bucket])
    for k, v in values.items():
        rows = rows.filter(F.col(k).eqNullSafe(v))
    return rows


def merge(rows: DataFrame, path: str, keys: list[str], combine: Combine, batch: int | None = None, writer: str = "", buckets: int = BUCKETS) -> int:
    """Merge rows into the table and return its version.

    ``combine`` takes old and new rows together and gives one row a key, of
    the same columns.  A ``batch`` whose number is not above the writer's
    last one changes nothing.
    """
    spark = rows.sparkSession
    state = manifest(spark, path) or {"version": 0, "count": buckets, "keys": keys, "schema": rows.schema.jsonValue(), "buckets": {}, "writers": {}}
    if batch is not None and state["writers"].get(writer, -1) >= batch:
        return state["version"]
    if state["keys"] != keys:
        raise ValueError(f"the table has keys {state['keys']}")
    place = bucket_of(keys, state["count"])
    touched = [r[0] for r in rows.select(place).distinct().collect()]  # at most ``count``
    version = state["version"] + 1
    folders = dict(state["buckets"])
    if touched:
        folder = f"{version:09d}-{uuid.uuid4().hex[:8]}"
        columns = StructType.fromJson(state["schema"]).names
        both = _stored(spark, path, state, touched).unionByName(rows.select(*columns))
        merged = combine(both).select(*columns).withColumn("bucket", place)
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
        fs, make, _ = files_of(spark, path)
        left = {s.getPath().getName() for s in fs.listStatus(make(f"{path}/data/{folder}"))}
        for b in touched:
            folders.pop(str(b), None)
            if f"bucket={b}" in left:
                folders[str(b)] = folder
    writers = state["writers"] | ({writer: batch} if batch is not None else {})
    _commit(spark, path, state | {"version": version, "buckets": folders, "writers": writers})
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what the last ``keep`` versions do not name; the folders that went.  Not to be run beside a merge."""
    known = versions(spark, path)
    if not known:
        return []
    used = {f for v in known[-keep:] for f in manifest(spark, path, v)["buckets"].values()}
    fs, make, _ = files_of(spark, path)
    for v in known[:-keep]:
        fs.delete(make(f"{path}/manifest/{v:09d}.json"), False)
    data = make(f"{path}/data")
    gone = sorted(s.getPath().getName() for s in fs.listStatus(data) if s.getPath().getName() not in used) if fs.exists(data) else []
    for name in gone:
        fs.delete(make(f"{path}/data/{name}"), True)
    return gone
