"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two group-and-join steps over links; a round's result is cut by
a reliable checkpoint, and the loop ends when neither step changes the links.
Only the count and a checksum of the links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def _sum(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root), root the smallest node reachable.

    Nodes without a link do not appear.  Links to itself and repeats are
    harmless; an empty table gives an empty one.
    """
    now = cut(links.select("a", "b").filter("a <> b").distinct())
    seen = _sum(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        new = cut(_small_star(_large_star(now).distinct()).distinct())
        check = _sum(new)
        now, old, seen = new, seen, check
        if check == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
