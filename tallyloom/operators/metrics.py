"""Classifier metrics and class weights from (truth, prediction) tables.

All come from confusion counts, so one small group-by holds the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every label seen; 0 where a share has no rows."""
    cells = confusion(rows, truth, predicted)
    by_label = (
        cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("c"))
        .select("c.*")
        .groupBy("label")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("called"), F.sum("tp").alias("tp"))
    )
    precision = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("called") > 0, 2 * F.col("tp") / (F.col("support") + F.col("called"))).otherwise(0.0)
    return by_label.select("label", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def single_label(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, macro_f1)."""
    right = rows.agg(F.round(F.avg((F.col(truth) == F.col(predicted)).cast("double")), 6).alias("accuracy"))
    macro = report(rows, truth, predicted).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return right.join(macro)


def multi_label(rows: DataFrame, truths: list[str], scores: list[str], threshold: float = 0.5) -> DataFrame:
    """(precision, recall, f1, exact): micro-averaged over label columns, 0 on zero division."""
    called = [F.col(s) >= threshold for s in scores]
    true = [F.col(t) == 1 for t in truths]
    tp = F.sum(sum(((a & b).cast("long") for a, b in zip(true, called)), F.lit(0)))
    pp = F.sum(sum((b.cast("long") for b in called), F.lit(0)))
    ap = F.sum(sum((a.cast("long") for a in true), F.lit(0)))
    same = F.lit(True)
    for a, b in zip(true, called):
        same = same & (a == b)
    sums = rows.agg(tp.alias("tp"), pp.alias("pp"), ap.alias("ap"), F.avg(same.cast("double")).alias("exact"))
    precision = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    recall = F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(0.0)
    f1 = F.when(F.col("pp") + F.col("ap") > 0, 2 * F.col("tp") / (F.col("pp") + F.col("ap"))).otherwise(0.0)
    return sums.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round("exact", 6).alias("exact"))


def class_weights(rows: DataFrame, label: str, labels: DataFrame | None = None) -> DataFrame:
    """(label, n, weight): total / (classes * count); a class of ``labels`` without rows counts one."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if labels is not None:
        counts = labels.select("label").join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    all_ = Window.partitionBy(F.lit(0))
    total, classes = F.sum("n").over(all_), F.count("*").over(all_)
    return counts.select("label", "n", F.round(total / (classes * F.greatest("n", F.lit(1))), 6).alias("weight"))


def positive_weights(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(label, positives, weight): (rows - positives) / positives, of each 0/1 column."""
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("long")).alias(f) for f in flags])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("label"), F.coalesce(F.col(f), F.lit(0)).alias("positives")) for f in flags])).alias("e")
    return sums.select("n", each).select("e.label", "e.positives", F.round((F.col("n") - F.col("e.positives")) / F.greatest("e.positives", F.lit(1)), 6).alias("weight"))
