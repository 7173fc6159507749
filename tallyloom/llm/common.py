"""Helpers shared by the corpus operators.

Word classes, ASCII lower-casing, the shared scratch folder and the lineage
cut.  Nothing here holds rows on the driver.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Java pattern of what separates alphanumeric words once A-Z is lowered.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Java pattern of what separates blank-delimited words.
BLANK_GAP = r"[\x20\x09-\x0D]+"

#: bytes.translate table: lowers A-Z and blanks every byte outside alphanumeric words.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)


def ascii_lower(text: Column) -> Column:
    """Lower A-Z only.  All-ASCII text takes the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gap: str) -> Column:
    """The non-empty runs between gaps; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so other names cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def named(column: str) -> Column:
    """A column by its exact name, which may hold dots and backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def carried(docs: DataFrame, keep: tuple[str, ...]) -> list[Column]:
    """The columns in ``keep`` under inner names (_k0, _k1 and so on) that no result has."""
    return [named(c).alias(f"_k{i}") for i, c in enumerate(keep)]


def schema_of(own: DataFrame, fields: str, keep: tuple[str, ...], prefix: str = "") -> StructType:
    """doc_id, result fields with ``prefix`` before their names, and kept columns under their own names."""
    kinds = {f.name: f.dataType for f in own.schema.fields}
    results = [StructField(prefix + f.name, f.dataType) for f in StructType.fromDDL(fields).fields]
    return StructType([StructField("doc_id", kinds["doc_id"]), *results, *[StructField(c, kinds[f"_k{i}"]) for i, c in enumerate(keep)]])


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of these names starts with, whatever its case."""
    prefix = "new_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return base.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """Only for a local master, where one machine runs everything; elsewhere the setting is required."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"tallyloom-{spark.sparkContext.applicationId}")


_folders: set[str] = set()
_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/tallyloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        fs, make = hadoop(spark, folder)
        fs.mkdirs(make(folder))
        fs.deleteOnExit(make(folder))
        _folders.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch paths within goes at the end; only for results that are stored elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(the file system of a path, a function that makes its paths)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def delete(spark: SparkSession, path: str) -> None:
    fs, make = hadoop(spark, path)
    fs.delete(make(path), True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cut lineage, and sizes known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator, rows: int = 1_000, size: int = 4_000_000) -> Iterator:
    """Slices of Arrow batches of at most ``rows`` rows and, but for a longer text alone, ``size`` bytes of column text, so that a worker holds few Python objects at a time."""
    for batch in batches:
        n, at = batch.num_rows, 0
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False) if "text" in batch.schema.names else np.zeros(n)
        upto = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        while at < n:
            end = int(np.searchsorted(upto, upto[at] + size, side="right")) - 1
            end = min(max(end, at + 1), at + rows, n)
            yield batch.slice(at, end - at)
            at = end


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that Python operators need no installation there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    uri = f"{shared_dir(spark)}/{sc.applicationId}/{root.name}.zip"
    fs, make = hadoop(spark, uri)
    out = fs.create(make(uri), True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(uri)
    _shipped.add(sc.applicationId)
