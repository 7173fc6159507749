"""A run of named stages that can be taken up where it stopped.

Each stage's rows are written to a folder of their own; a marker, written
whole by a rename once they are all there, names the folder, the stage's
version and what was observed of its rows on the way.  A run that finds a
stage's marker reads its rows instead of making them; a changed version
makes that stage and all later ones anew.  What a broken attempt wrote is
never named and so never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.sources.snapshots import files_of


@dataclass
class Stage:
    name: str
    #: Takes the rows of the stages before by name.
    make: Callable[[dict[str, DataFrame]], DataFrame]
    version: str = "1"
    #: Aggregates of the stage's rows, observed while they are written.
    metrics: dict[str, Column] = field(default_factory=dict)


def finished(spark: SparkSession, path: str) -> dict[str, dict]:
    """Markers of the stages that are done, by name."""
    fs, make, _ = files_of(spark, path)
    folder = make(f"{path}/done")
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    return {n[:-5]: json.loads(spark.read.text(f"{path}/done/{n}", wholetext=True).first()[0]) for n in found}


def _mark(spark: SparkSession, path: str, name: str, state: dict) -> None:
    fs, make, _ = files_of(spark, path)
    part, final = make(f"{path}/done/.{uuid.uuid4().hex}"), make(f"{path}/done/{name}.json")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"cannot mark stage {name} in {path}")


def run(spark: SparkSession, path: str, stages: list[Stage]) -> dict[str, DataFrame]:
    """The rows of all stages by name, made or read."""
    done, rows, again = finished(spark, path), {}, False
    for stage in stages:
        state = done.get(stage.name)
        again = again or state is None or state["version"] != stage.version
        if again:
            made, seen = stage.make(rows), Observation(f"{stage.name}-{uuid.uuid4().hex}")
            folder = f"{stage.name}-{uuid.uuid4().hex[:8]}"
            counts = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in stage.metrics.items()]]
            made.observe(seen, *counts).write.parquet(f"{path}/data/{folder}")
            state = {"version": stage.version, "folder": folder, "schema": made.schema.jsonValue(), "metrics": seen.get}
            _mark(spark, path, stage.name, state)
        rows[stage.name] = spark.read.schema(StructType.fromJson(state["schema"])).parquet(f"{path}/data/{state['folder']}")
    return rows
