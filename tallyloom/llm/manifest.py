"""Merkle manifest of a dataset, and versions of it in which one leaf is tampered with.

A row is a leaf: H, the SHA-256 in lower-case hex, of its fields, each ``-``
if null and else its UTF-8 byte count, ``:`` and its value.  Within a group
leaves ascend by id; while several nodes remain, every ``FAN`` consecutive
ones, the last run being what is left, become the H of their digests.  What
remains is the group's subroot, and subroots in order of their groups, null
first, become the root in the same way.

Method: a persistent tree that copies paths.  Leaves are dealt into aligned
blocks of ``FAN ** LEVELS`` (512), whose node is found in one task; a tampered leaf
opens a version that copies the nodes from the leaf up to the block's node
and shares every other node with the version before.  Above the blocks the
tree goes on in Spark: blocks of blocks, each row the path of one block, by
which a version carries on to the root; its copies there are the
digests that are folded, as siblings are shared.

Scale: text is read once and hashed in the JVM, and is not shuffled.  Places
come from a range partition by group and id with repeated rows kept apart by
a row number, so a group may hold all rows.  A block is at most 512 leaves
of some 200 bytes.  There are rows / 512 blocks, rows / 512^2 blocks of
blocks and so on; each round is a group-by, and none is collected.

Defined results: null and empty texts differ (``-`` and ``0:``); leaves with
a null id come last in their group and are never tampered with; rows that
repeat an id are leaves of their own, ordered by digest; tampering that
changes nothing (null texts, or none of A-Z) gives the original root; one
leaf alone is its own root, with H of nothing as proof; an empty table gives
an empty result; texts of any length are hashed whole.  Other columns are
dropped unless in ``keep``, and results take ``prefix`` before their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyloom.llm.common import LOWER, UPPER, carried, named, schema_of, ship, written

FAN = 8
#: Levels of a block that one task builds.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's CRC-32 is a multiple of this are tampered with.
TAMPERED = 3


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class PathTree:
    """Nodes of a tree of digests, only ever added to; a version is the number of its top node.

    ``base`` is the version of the leaves given.  ``tampered`` makes another
    one by copying the path above a leaf; children off the path are shared.
    """

    def __init__(self, leaves: list[str], levels: int):
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._add(tuple(row[i : i + FAN])) for i in range(0, len(row), FAN)]
        self.base = row[0]

    def _add(self, children: tuple[int, ...]) -> int:
        self.children.append(children)
        self.digests.append(digest([self.digests[c] for c in children]))
        return len(self.digests) - 1

    def path(self, leaf: int, version: int) -> list[tuple[int, int]]:
        """(node, which child of it comes next) from the top of a version down to a leaf."""
        out, node = [], version
        for level in reversed(range(self.levels)):
            at = leaf // FAN**level % FAN
            out.append((node, at))
            node = self.children[node][at]
        return out

    def tampered(self, leaf: int, new: str, version: int | None = None) -> int:
        """The version after a leaf's digest became ``new``."""
        self.digests.append(new)
        self.children.append(())
        node = len(self.digests) - 1
        for above, at in reversed(self.path(leaf, self.base if version is None else version)):
            own = self.children[above]
            node = self._add((*own[:at], node, *own[at + 1 :]))
        return node

    def siblings(self, leaf: int, version: int | None = None) -> list[tuple[str, str]]:
        """For each level from the leaf up, the digests before and after its run's node, each joined."""
        out = []
        for above, at in reversed(self.path(leaf, self.base if version is None else version)):
            names = [self.digests[c] for c in self.children[above]]
            out.append(("".join(names[:at]), "".join(names[at + 1 :])))
        return out


def field_hash(columns: list[Column]) -> Column:
    """H of a row's fields."""
    parts = []
    for c in columns:
        x = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with ``at``, their place within their group by ``order`` (nulls last), and ``size``, the group's rows; written once.

    ``order`` must tell all rows apart.
    """
    by = [F.asc_nulls_last(c) for c in order]
    ranged = written(rows.repartitionByRange(F.asc(group), *by).withColumn("part", F.spark_partition_id()), name)
    counts = ranged.groupBy(group, "part").agg(F.count("*").alias("own"))
    # One row a group and partition.
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(group, "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy(group)).alias("size"))
    no = F.row_number().over(Window.partitionBy("part", group).orderBy(*by))
    return ranged.join(sums, [group, "part"]).withColumn("at", F.col("before") + no - 1).drop("part", "before")


def _blocks(nodes: DataFrame, group: str, fields: list[str], most: int) -> DataFrame:
    """(group, block, levels, members): blocks of ``FAN ** most`` nodes in order of place; fewer levels are built where the group has fewer nodes."""
    width = FAN**most
    members = F.array_sort(F.collect_list(F.struct((F.col("at") % width).cast("int").alias("pos"), *fields))).alias("members")
    whole = nodes.groupBy(group, F.floor(F.col("at") / width).alias("block"), "size").agg(members)
    levels = sum((F.col("size") > FAN**h).cast("int") for h in range(most))
    return whole.select(group, "block", levels.alias("levels"), "members")


def upper_paths(tops: DataFrame, group: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Paths from nodes to their group's top, and the tops.

    tops: (group, at, size, digest).  Gives (group, at, path) with path an
    array of (before, after), and (group, digest).
    """
    ship(tops.sparkSession)
    width = FAN**levels
    kind = tops.schema[group].dataType
    fields = StructType([StructField(group, kind)])
    for name, ddl in (("at", "long"), ("path", "array<struct<before:string,after:string>>"), ("block", "long"), ("digest", "string")):
        fields = fields.add(name, StructType.fromDDL(f"x {ddl}").fields[0].dataType)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                tree = PathTree([m["digest"] for m in one["members"]], one["levels"])
                found = [
                    {group: one[group], "at": one["block"] * width + m["pos"], "path": [{"before": b, "after": a} for b, a in tree.siblings(i)], "block": one["block"], "digest": tree.digests[tree.base]}
                    for i, m in enumerate(one["members"])
                ]
                for i in range(0, len(found), 512):
                    yield pa.RecordBatch.from_pylist(found[i : i + 512], schema=arrow)

    text = pa.string()
    arrow = pa.schema([(group, {"string": text, "int": pa.int32()}[kind.simpleString()]), ("at", pa.int64()), ("path", pa.list_(pa.struct([("before", text), ("after", text)]))), ("block", pa.int64()), ("digest", text)])
    found = written(_blocks(tops, group, ["digest"], levels).mapInArrow(climb, fields), "paths")
    above = found.groupBy(group, "block").agg(F.first("digest").alias("digest"))
    most = tops.agg(F.max("size")).first()[0] or 0
    if most <= width:
        return found.select(group, "at", "path"), above.select(group, "digest")
    sizes = tops.select(group, F.ceil(F.col("size") / width).alias("size")).distinct()
    paths, ends = upper_paths(written(above.withColumnRenamed("block", "at").join(sizes, group), "tops"), group, levels)
    up = paths.select(F.col(group).alias("_g"), F.col("at").alias("_b"), F.col("path").alias("_up"))
    joined = found.join(up, (F.col(group) == F.col("_g")) & (F.col("block") == F.col("_b")))
    return joined.select(group, "at", F.concat("path", "_up").alias("path")), ends


def fold(new: str, path: list[tuple[str, str]]) -> str:
    """The top that a digest gives with the siblings of its path."""
    for before, after in path:
        new = digest([before, new, after])
    return new


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, text_col: str = "text", tampered: int = TAMPERED, levels: int = LEVELS, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, kept columns) of each row.

    ``fields`` are hashed in that order; rows whose id's CRC-32 is a multiple
    of ``tampered`` have A-Z of ``text_col`` lowered, in a version of their own.
    ``levels`` are built in one task: blocks of ``FAN ** levels`` leaves.
    """
    spark = docs.sparkSession
    ship(spark)
    leaf = field_hash([named(c) for c in fields])
    lowered = F.translate(named(text_col), UPPER, LOWER)
    changed = field_hash([lowered if c == text_col else named(c) for c in fields])
    touched = F.crc32(named(id_col).cast("string").cast("binary")) % tampered == 0
    # A group's name as a string that sorts null first and else by bytes.
    group = F.coalesce(F.concat(F.lit("="), named(group_col).cast("string")), F.lit("")).alias("grp")
    own = docs.select(named(id_col).alias("doc_id"), group, leaf.alias("leaf"), F.when(touched, changed).alias("changed"), *carried(docs, keep))
    kept = [f"_k{i}" for i in range(len(keep))]
    # Written before they are dealt out by range, which reads its input twice.
    hashed = written(own.withColumn("row", F.monotonically_increasing_id()), "hashed")
    placed = written(_placed(hashed, "grp", ["doc_id", "leaf", "row"], "leaves"), "placed")
    blocks = _blocks(placed, "grp", ["doc_id", "leaf", "changed", *kept], levels)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                tree = PathTree(one.column("members").flatten().field("leaf").to_pylist(), one.column("levels")[0].as_py())
                yield pa.RecordBatch.from_arrays([one.column("grp"), one.column("block"), pa.array([tree.digests[tree.base]])], names=["grp", "at", "digest"])

    bare = _blocks(placed, "grp", ["leaf"], levels)
    tops = written(bare.select("grp", "block", "levels", "members").mapInArrow(top, "grp string, at long, digest string"), "block-tops")
    sizes = placed.select("grp", F.ceil(F.col("size") / FAN**levels).alias("size")).distinct()
    paths, subroots = upper_paths(written(tops.join(sizes, "grp"), "sized-tops"), "grp", levels)
    subroots = written(subroots, "subroots")
    ranked = written(_placed(subroots.withColumn("all", F.lit(0)), "all", ["grp"], "subroot-ranges"), "placed-subroots")
    over, roots = upper_paths(ranked.select("all", "at", "size", "digest"), "all", levels)
    group_paths = ranked.join(over.select("at", "path"), "at").join(roots.select("all", F.col("digest").alias("root")), "all")
    group_paths = group_paths.select(F.col("grp"), F.col("digest").alias("subroot"), "root", F.col("path").alias("over"))
    way = paths.withColumnRenamed("at", "block").join(group_paths, "grp").select("grp", "block", F.concat("path", "over").alias("path"), "subroot", "root")
    schema = schema_of(own, "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", keep, prefix)
    names = [f.name for f in schema.fields]

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                members = one.column("members").flatten()
                leaves, new = members.field("leaf").to_pylist(), members.field("changed").to_pylist()
                path = [(p["before"], p["after"]) for p in one.column("path")[0].as_py()]
                subroot, root = one.column("subroot")[0].as_py(), one.column("root")[0].as_py()
                tree = PathTree(leaves, one.column("levels")[0].as_py())
                above = "".join(b + a for b, a in path)
                proofs, folded = [], []
                for i, other in enumerate(new):
                    proofs.append(digest([b + a for b, a in tree.siblings(i)] + [above]))
                    version = tree.base if other is None else tree.tampered(i, other)
                    folded.append(fold(tree.digests[version], path))
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [members.field("doc_id"), pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded]), *[members.field(k) for k in kept]],
                    names=names,
                )

    return blocks.join(way, ["grp", "block"]).select("levels", "path", "subroot", "root", "members").mapInArrow(versions, schema)
