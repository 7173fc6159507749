"""An inverted file of vectors: cells around learned centres, probed in order of distance, re-ranked exactly.

``write_index`` learns the centres with Spark ML's k-means and stores every
vector under the folder of its cell, beside a table of the cells.  ``search``
reads only the folders that some query probes, by partition pruning, scores
what it finds exactly and keeps the best.

A search is approximate with ``probes`` cells a query; their number is found
when the index is written, from the exact neighbours of a sample.  With ``exact``
a part of them gives a bound first: the k-th score found there bounds the
distance of anything better, and a cell whose centre is farther away than that
bound and the cell's radius cannot hold it.  The cells that may are read, so
the result equals a comparison with all vectors.

Scale: centres are at most ``MAX_CELLS``, learned from ``ROWS_A_CELL`` rows a
cell at most, first by hash of the id; all rows are assigned and stored.
Crowded cells are written by several tasks.  Queries ride along in blocks
with a bit for each cell that they probe, and tasks find their k best by
matrix products (``neighbours``); a task keeps k rows a query before anything is shuffled.

Defined results: rows without a vector are not stored and queries without
one find nothing; an empty table gives an index that finds nothing; ties go
to the smaller id; vectors of zeros have cosine 0 with all.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.vectors import as_double, relevance
from tallyloom.operators import neighbours

MAX_CELLS = 4096
ROWS_A_CELL = 256
#: Stored rows that one task writes.
ROWS_A_FILE = 500_000
#: Stored rows, about, whose exact neighbours tell how many cells a search is to probe, and the share of them it is to find.
SAMPLE = 100
RECALL = 0.95
CELL = "cell int, centre array<double>, radius double, n long, by string"
#: Scores are rounded to six digits, which the bound of an exact search allows for.
SLACK = 2e-6
#: Of the cells that a search by default probes, the part that an exact one takes its bound from.
BOUND_SHARE = 4


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def write_index(vectors: DataFrame, path: str, by: str = "l2", cells: int | None = None, seed: int = 42, recall: float = RECALL, keep: tuple[str, ...] = ()) -> None:
    """Store (vec_id, embedding, kept columns) under ``path``; by: l2 or cosine; cells: the square root of the number of rows by default; recall: what a search by default is to find."""
    own = neighbours.dealt_out(vectors.select("vec_id", "embedding", *keep).filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)))
    spark, total = vectors.sparkSession, own.count()
    cells = max(2, min(cells or math.isqrt(total), MAX_CELLS))
    own = own.withColumn("_v", as_double(F.col("embedding")))
    own = own.withColumn("_v", _unit(F.col("_v")) if by == "cosine" else F.col("_v"))
    if not total:
        spark.createDataFrame([], CELL).write.parquet(f"{path}/cells")
        return
    share = cells * ROWS_A_CELL / total
    fitted = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share * 1_000_000) if share < 1 else own
    fitted = fitted.withColumn("_x", array_to_vector("_v"))
    few = fitted.select("_v").distinct().limit(2 * cells).collect()
    if len(few) < 2 * cells:  # too few different vectors to learn from: they are the centres
        centres = np.array(sorted(r[0] for r in few))
    else:
        model = KMeans(k=cells, seed=seed, featuresCol="_x", maxIter=20).fit(fitted.select("_x"))
        centres = np.array(model.clusterCenters())

    @F.pandas_udf("struct<cell:int,_d:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy())
        half = (centres**2).sum(axis=1) / 2
        cell = np.concatenate([np.argmin(half - x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)])
        return pd.DataFrame({"cell": cell.astype(np.int32), "_d": np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))})

    own = own.withColumn("_at", nearest("_v")).select("vec_id", "embedding", *keep, "_at.*")
    sizes = own.groupBy("cell").agg(F.max("_d").alias("radius"), F.count("*").alias("n"))
    met = sizes.join(_centre_rows(spark, centres), "cell").select("cell", "centre", "radius", "n", F.lit(by).alias("by"))
    met.coalesce(1).write.parquet(f"{path}/cells")  # MAX_CELLS rows at most
    parts = F.ceil(F.col("n") / ROWS_A_FILE)
    dealt = own.join(F.broadcast(spark.read.schema(CELL).parquet(f"{path}/cells").select("cell", "n")), "cell")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("vec_id"), parts)).drop("n", "_d")
    dealt.repartition("cell", "_part").drop("_part").write.partitionBy("cell").parquet(f"{path}/vectors")
    sample = own.select("vec_id", "embedding").filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, total // SAMPLE))) == 0).limit(2 * SAMPLE)
    spark.createDataFrame([(probes_for(spark, path, sample, recall=recall),)], "probes int").write.parquet(f"{path}/probes")


def _centre_rows(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")


def _distances(block: neighbours.Block, cells: list) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, distances of queries from there on to the centres of all cells), some queries at a time."""
    centres = np.array([c.centre for c in cells])
    squares = (centres * centres).sum(axis=1)
    for i in range(0, len(block.matrix), neighbours.PIECE_QUERIES):
        q = block.matrix[i : i + neighbours.PIECE_QUERIES]
        if cells[0].by == "cosine":
            norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
            q = q / np.where(norm > 0, norm, 1)
        yield i, np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + squares - 2 * q @ centres.T, 0))


def _nearest_cells(block: neighbours.Block, cells: list, probes: int) -> np.ndarray:
    """Bits of the queries, a row a cell: whether it is one of their ``probes`` nearest."""

    def few(d: np.ndarray) -> np.ndarray:
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
        return out

    return np.concatenate([np.packbits(few(d).T, axis=1) for _, d in _distances(block, cells)], axis=1)


def _cells_within(block: neighbours.Block, cells: list, bound: np.ndarray) -> np.ndarray:
    """The same for the cells that may hold a vector within the bound of a query."""
    radii = np.array([c.radius for c in cells])
    size = max(float(np.abs(np.array([c.centre for c in cells])).max()), float(np.abs(block.matrix).max(initial=0)))
    slack = 1e-6 * (1 + size)  # of distances that are differences of squares
    return np.concatenate([np.packbits((d - radii - slack <= bound[i : i + len(d), None]).T, axis=1) for i, d in _distances(block, cells)], axis=1)


def _folders(spark: SparkSession, path: str, wanted: list) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(wanted))


def probed(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """The stored vectors of the distinct cells in column ``cell``, which are at most ``MAX_CELLS``; other folders are not read."""
    wanted = [r.cell for r in cells.select("cell").distinct().collect()]
    return _folders(spark, path, wanted)


def _stored_probes(spark: SparkSession, path: str) -> int:
    return spark.read.schema("probes int").parquet(f"{path}/probes").first()[0]


def probes_for(spark: SparkSession, path: str, sample: DataFrame, k: int = 5, recall: float = RECALL) -> int:
    """The least number of cells to probe that finds the share ``recall`` of the exact neighbours of a bounded sample of queries."""
    cells = spark.read.schema(CELL).parquet(f"{path}/cells").collect()
    places, numbers = {}, [c.cell for c in cells]
    own = list(neighbours.blocks(_asked(sample)))  # of a bounded sample
    for block in own:
        for i, d in _distances(block, cells):
            for query, order in zip(block.ids[i : i + len(d)].to_pylist(), np.argsort(d, axis=1, kind="stable")):
                places[query] = {numbers[c]: place for place, c in enumerate(order, 1)}
    counts = np.zeros(len(cells) + 1)
    for r in _searched(spark, path, own, cells, k, len(cells), False).select("query_id", "cell").collect():
        counts[places[r.query_id][r.cell]] += 1
    return max(1, int(np.searchsorted(np.cumsum(counts), recall * counts.sum())))


def read_share(spark: SparkSession, path: str, queries: DataFrame, probes: int | None = None) -> float:
    """The share of stored rows that lies in the cells which these queries probe."""
    cells = spark.read.schema(CELL).parquet(f"{path}/cells").collect()
    if not cells:
        return 0.0
    probes = probes or _stored_probes(spark, path)
    met = [np.bitwise_or.reduce(_nearest_cells(block, cells, probes), axis=1) > 0 for block in neighbours.blocks(_asked(queries))]
    return sum(c.n for c, m in zip(cells, np.any(met, axis=0)) if m) / sum(c.n for c in cells) if met else 0.0


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("vec_id").alias("query_id"), "embedding")


def _best(spark: SparkSession, path: str, block: neighbours.Block, bits: np.ndarray, cells: list, k: int, limits: np.ndarray | None = None) -> DataFrame:
    """The k best of each query among the cells whose bit it has."""
    row, n, by = {c.cell: i for i, c in enumerate(cells)}, len(block.matrix), cells[0].by
    rows = _folders(spark, path, [c.cell for c, b in zip(cells, bits) if b.any()])
    found = neighbours.best(rows, block, k, by, lambda c: np.unpackbits(bits[row[c]], count=n).astype(bool), limits)
    return _ranked(found.withColumn("score", F.round("score", 6)), k, by)


def _ranked(rows: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score") if by == "l2" else F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score, relevance, kept columns): up to k neighbours of each query (vec_id, embedding).

    ``probes`` are those stored with the index unless given.
    """
    cells = spark.read.schema(CELL).parquet(f"{path}/cells").collect()  # MAX_CELLS rows at most
    if not cells:
        none = spark.createDataFrame([], "rank int, vec_id long, score double, relevance double")
        return queries.limit(0).select(F.col("vec_id").alias("query_id")).join(none, F.col("query_id") == F.col("vec_id"))
    probes = probes or _stored_probes(spark, path)
    found = _searched(spark, path, neighbours.blocks(_asked(queries)), cells, k, probes, exact)
    kept = [c for c in found.columns if c not in ("query_id", "rank", "vec_id", "score", "cell")]
    return found.select("query_id", "rank", "vec_id", "score", F.round(relevance(F.col("score")), 6).alias("relevance"), *kept)


def _searched(spark: SparkSession, path: str, blocks: Iterable[neighbours.Block], cells: list, k: int, probes: int, exact: bool) -> DataFrame:
    """(query_id, rank, vec_id, score, cell, kept columns)."""
    parts = []
    for block in blocks:
        if not exact or len(cells) <= probes:
            parts.append(_best(spark, path, block, _nearest_cells(block, cells, probes), cells, k))
            continue
        # A rough answer is enough for a bound.
        first = _best(spark, path, block, _nearest_cells(block, cells, -(-probes // BOUND_SHARE)), cells, k)
        limits = _limits(first, block, k, cells[0].by)
        squared = limits + SLACK if cells[0].by == "l2" else 2 * (1 - limits + SLACK)
        bound = np.sqrt(np.maximum(squared, 0)) + SLACK
        parts.append(_best(spark, path, block, _cells_within(block, cells, bound), cells, k, limits))
    if not parts:
        rows = spark.read.parquet(f"{path}/vectors").limit(0).drop("embedding")
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0.0).alias("score"), *rows.columns, F.lit(1).alias("rank"))
    return reduce(DataFrame.union, parts)


def _limits(found: DataFrame, block: neighbours.Block, k: int, by: str) -> np.ndarray:
    """The k-th score of each query of a block, or what bounds nothing where there are fewer."""
    worst = found.groupBy("query_id").agg(F.count("*").alias("n"), (F.max("score") if by == "l2" else F.min("score")).alias("score"))
    known = worst.filter(F.col("n") == k).select("query_id", "score").toArrow()  # a row a query of the block
    at = pc.index_in(known.column("query_id").combine_chunks(), block.ids).to_numpy()
    out = np.full(len(block.matrix), np.inf if by == "l2" else -np.inf)
    out[at] = known.column("score").to_numpy()
    return np.where(np.isnan(out), np.inf if by == "l2" else -np.inf, out)


# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
