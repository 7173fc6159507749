"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id), which keeps equal texts
together as far as shards of near-equal size allow.  A size-weighted sample
of keys (exponential keys: the records with the least -ln(u) / size) gives
quantile boundaries; records are range-partitioned at them; a range that
holds more than its share, such as a text with many copies, is subdivided by
a hash of doc_id.  Exact sums of the ranges then place every record on one
line of bytes, and a shard is a piece of that line.

Records of at least 1 / ``HEAVY`` of a shard (there are at most shards *
HEAVY of them) would leave the pieces uneven; they are dealt beforehand,
largest first, each to the least filled shard, and come first in its slots.
The pieces of the line level what is left, so shards differ by less than a
record of 1 / HEAVY of a shard, unless one record alone exceeds a shard.

Law ``bytes``: shard sizes are near equal.  Slots count from 0 in key order
within each shard.

Defined results: null text has no bytes and the checksum of an empty one;
rows that repeat a doc_id are records of their own; texts of any length are
one record; other columns are dropped; an empty table gives an
empty result; all sizes are at least ``overhead``, so empty texts spread too.

Scale: text is read once for size and checksums; what is sorted and summed is
five numbers a record.  The driver holds the sample and the sums of ranges,
both bounded by the number of ranges.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, ship, written

SHARDS = 40
OVERHEAD = 16
#: Sampled keys for each range.
OVERSAMPLE = 32
#: A record of this part of a shard's share is dealt by itself.
HEAVY = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, key) of each row."""
    text = F.coalesce("text", F.lit(""))
    return id_and_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def sampled_splitters(rows: DataFrame, ranges: int, oversample: int = OVERSAMPLE) -> np.ndarray:
    """Up to ranges - 1 ascending keys that cut the bytes of ``rows`` into near-equal ranges."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit("splitter")), 11) + 1) / F.lit(float(1 << 53))
    drawn = rows.orderBy(-F.log(u) / F.col("size"), "key").limit(ranges * oversample).select("key").collect()
    keys = np.sort(np.array([r[0] for r in drawn], dtype=np.int64))
    if not len(keys):
        return keys
    return np.unique(keys[[len(keys) * i // ranges for i in range(1, ranges)]])


def deal_heavy(heavy: list[tuple], shards: int) -> tuple[list[tuple], np.ndarray]:
    """Largest first to the least filled shard: (key, doc_id, size, crc, shard, slot) rows, and the bytes in each shard."""
    filled = np.zeros(shards, dtype=np.int64)
    count = np.zeros(shards, dtype=np.int64)
    dealt = []
    for doc_id, size, crc, key in sorted(heavy, key=lambda r: (-r[1], r[3], str(r[0]))):
        s = int(np.argmin(filled))
        dealt.append((doc_id, size, crc, key, s, int(count[s])))
        filled[s] += size
        count[s] += 1
    return dealt, filled


def levelled(filled: np.ndarray, total: int) -> np.ndarray:
    """Ends of each shard's piece of a line of ``total`` bytes, so that all shards come to one level where they can."""
    order = np.sort(filled)
    for n in range(len(order), 0, -1):
        level = (total + order[:n].sum()) / n
        if level >= order[n - 1]:
            break
    ends = np.floor(np.cumsum(np.maximum(0.0, level - filled))).astype(np.int64)
    ends[-1] = max(ends[-1], total) + 1
    return ends


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = OVERHEAD,
    ranges: int | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    ranges = ranges or max(4 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = written(records(docs, id_col, text_col, overhead), "records")
    total, most = every.agg(F.sum("size"), F.max("size")).first()
    limit = max(1, (total or 0) // (shards * HEAVY))
    heavy: list[tuple] = []
    if most and most >= limit and total >= limit * shards * HEAVY:
        heavy = [tuple(r) for r in every.filter(F.col("size") >= limit).limit(shards * HEAVY * 2).collect()]
    dealt, filled = deal_heavy(heavy, shards)
    rows = every.filter(F.col("size") < limit) if heavy else every
    total = (total or 0) - int(filled.sum())
    ends = levelled(filled, total)
    splitters = sampled_splitters(rows, ranges)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("int")
    def shard_of(middles: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, middles.to_numpy(), side="right").astype(np.int32))

    ranged = rows.withColumn("range", range_of("key"))
    share = max(1, math.ceil(total / ranges))
    sums = {r[0]: r[1] for r in ranged.groupBy("range").agg(F.sum("size")).collect()}
    parts = np.ones(ranges, dtype=np.int64)
    for k, size in sums.items():
        parts[k] = math.ceil(size / share) if size > 2 * share else 1
    wide = {int(k): int(n) for k, n in enumerate(parts) if n > 1}
    n_parts = F.coalesce(*[F.when(F.col("range") == k, F.lit(n)) for k, n in wide.items()], F.lit(1))
    divided = ranged.withColumn("part", F.pmod(F.xxhash64("doc_id"), n_parts).cast("int") if wide else F.lit(0))

    sums = sorted(tuple(r) for r in divided.groupBy("range", "part").agg(F.sum("size"), F.count("*")).collect())
    bases, before = [], 0
    for k, p, size, _ in sums:
        bases.append((k, p, before))
        before += size
    base = spark.createDataFrame(bases, "range int, part int, base long")
    line = Window.partitionBy("range", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.floor(F.col("base") + F.col("until") - F.col("size") / 2)
    placed = written(
        divided.withColumn("until", F.sum("size").over(line))
        .withColumn("place", F.row_number().over(line))
        .join(F.broadcast(base), ["range", "part"])
        .withColumn("shard", shard_of(middle))
        .select("doc_id", "size", "text_crc32", "key", "range", "part", "shard", "place"),
        "placed",
    )
    # A part's records lie in a row of shards; each needs how many of the shard came in parts before.
    counts = sorted(tuple(r) for r in placed.groupBy("range", "part", "shard").count().collect())
    filled = defaultdict(int)
    for row in dealt:
        filled[row[4]] += 1
    shifts, last, seen = [], None, 0
    for k, p, s, n in counts:
        if (k, p) != last:
            last, seen = (k, p), 0
        shifts.append((k, p, s, filled[s] - seen - 1))
        filled[s] += n
        seen += n
    shift = spark.createDataFrame(shifts, "range int, part int, shard int, shift long")
    light = placed.join(F.broadcast(shift), ["range", "part", "shard"]).select(
        "doc_id", "size", "text_crc32", "key", "shard", (F.col("place") + F.col("shift")).cast("long").alias("slot")
    )
    return light.union(spark.createDataFrame(dealt, light.schema)) if dealt else light


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as one folder a shard, in slot order within each file; gives the placement.  Ids must be unique."""
    placement = shard(docs, shards, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard", "slot")
    rows = docs.join(placement, id_col)
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placement
