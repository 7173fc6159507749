"""A grader learned from graded answers: a random forest over an answer's features, by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["similarity", "contradiction", "entailment", "n_words"]


def train_grader(rows: DataFrame, features: list[str] | None = None, label: str = "label", trees: int = 20, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Fit on rows with the features and a label in 0-1; rows without a label or a feature are left out."""
    names = features or FEATURES
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("double").alias("_y")).dropna()
    forest = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_score", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), forest]).fit(known)


def grade(model: PipelineModel, rows: DataFrame, out: str = "predicted") -> DataFrame:
    """rows with a score in 0-1; null where a feature is missing."""
    names = model.stages[0].getInputCols()
    assembler = model.stages[0].copy().setHandleInvalid("keep")
    scored = model.stages[1].transform(assembler.transform(rows.withColumns({c: F.col(c).cast("double") for c in names})))
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    score = F.when(whole, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))), 6))
    kinds = dict(rows.dtypes)
    return scored.select(*[F.col(c).cast(kinds[c]).alias(c) if c in names else F.col(c) for c in rows.columns], score.alias(out))
