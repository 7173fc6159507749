"""Vectors of text without a neural encoder: latent semantic analysis of hashed tf-idf, factorised at random and in parallel.

A text is its words' buckets, counted, times their inverse document
frequency, at unit length.  The model is the leading right singular vectors
of the matrix of all texts.  They are found by subspace iteration: a random
basis of ``size + EXTRA`` directions is multiplied by the Gram matrix, one
Spark job a round, and made orthonormal again; the last round's products
give the directions in order of weight.  A text's vector is its row times
those directions, at unit length, so a dot product is a cosine.

Scale: the Gram matrix is never made.  A task multiplies its rows by the
basis, ``BATCH`` at a time, and gives one row a bucket, which are added by
bucket; the driver holds buckets times directions numbers.  Texts are hashed
and stored once, and read once a round.

Defined results: texts without words, and those all of whose words lie
outside the directions, have a vector of zeros and cosine 0; an empty table
gives a model all of whose vectors are zeros.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.training import word_buckets

BUCKETS = 4096
EXTRA = 8
ROUNDS = 4
#: Rows that are made dense at once.
BATCH = 256
#: Targets of ``best_targets``, which ride along as one matrix.
TARGETS = 50_000


@dataclass
class Model:
    idf: np.ndarray
    #: One column a direction, heaviest first, and their singular values.
    directions: np.ndarray
    weights: np.ndarray


def dense(words: list, idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows of lists of buckets."""
    lists = [np.asarray([] if w is None else w, dtype=np.int64) for w in words]
    row = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
    flat = np.concatenate([*lists, np.zeros(0, dtype=np.int64)])
    x = np.bincount(row * len(idf) + flat, minlength=len(lists) * len(idf)).reshape(len(lists), len(idf)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def idf_of(stored: DataFrame, buckets: int) -> np.ndarray:
    """ln((1 + texts) / (1 + texts with the bucket)) + 1."""
    counts = np.zeros(buckets)
    for b, n in stored.select(F.explode(F.array_distinct("words")).alias("b")).groupBy("b").count().toLocalIterator():  # a row a bucket
        counts[b] = n
    return np.log((1 + stored.count()) / (1 + counts)) + 1


def gram_times(stored: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of the tf-idf rows times a basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                # Arrays of some rows: lists of a whole batch would hold an object a word.
                x = dense(batch.column(0).slice(i, BATCH).to_numpy(zero_copy_only=False), idf)
                total += x.T @ (x @ basis)
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[b].tobytes() for b in at], pa.binary())], names=["b", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(r, dtype=float) for r in table.column("row").to_pylist()]
        return pa.table({"b": table.column("b").slice(0, 1), "row": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})

    sums = stored.select("words").mapInArrow(run, "b long, row binary").groupBy("b").applyInArrow(add, "b long, row binary")
    out = np.zeros(basis.shape)
    for b, row in sums.toLocalIterator():  # a row a bucket
        out[b] = np.frombuffer(bytes(row), dtype=float)
    return out


def fit(texts: DataFrame, keep: Callable[[DataFrame], DataFrame], size: int = 64, buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = 42) -> Model:
    """A model of column ``text``; ``keep`` stores the hashed texts and reads them back."""
    stored = keep(texts.select(word_buckets(F.col("text"), buckets).alias("words")))
    idf = idf_of(stored, buckets)
    wide = min(size + EXTRA, buckets)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, wide)))[0]
    product = gram_times(stored, idf, basis)
    for _ in range(rounds - 1):
        basis = np.linalg.qr(product)[0]
        product = gram_times(stored, idf, basis)
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:size]
    weights = np.sqrt(np.maximum(values[order], 0))
    useful = weights > 1e-6 * max(weights.max(initial=0), 1e-12)
    return Model(idf, (basis @ turn[:, order]) * useful, weights * useful)


def vectors(model: Model, words: list) -> np.ndarray:
    v = dense(words, model.idf) @ model.directions
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, v / np.where(norm > 1e-9, norm, 1), 0.0)


def embed(model: Model, rows: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
    """rows with the vector of a text column."""

    @F.pandas_udf("array<double>")
    def vector(words: pd.Series) -> pd.Series:
        lists = words.tolist()
        return pd.Series([v for i in range(0, len(lists), BATCH) for v in vectors(model, lists[i : i + BATCH]).tolist()])

    return rows.withColumn(out, vector(word_buckets(F.col(text), len(model.idf))))


def similarity(model: Model, rows: DataFrame, one: str, other: str, out: str = "similarity") -> DataFrame:
    """rows with the cosine of the vectors of two text columns, whole texts both."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b, found = a.tolist(), b.tolist(), []
        for i in range(0, len(a), BATCH):
            found.append((vectors(model, a[i : i + BATCH]) * vectors(model, b[i : i + BATCH])).sum(axis=1))
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    n = len(model.idf)
    return rows.withColumn(out, cosine(word_buckets(F.col(one), n), word_buckets(F.col(other), n)))


def best_targets(model: Model, rows: DataFrame, targets: DataFrame, text: str = "text") -> DataFrame:
    """rows with ``target`` and ``cosine``: the nearest of up to ``TARGETS`` described targets (target, text); earlier ones win ties."""
    known = embed(model, targets.select("target", "text")).select("target", "vector").orderBy("target").limit(TARGETS + 1).collect()
    if len(known) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets; search a stored index of their vectors instead")
    names, matrix = [r.target for r in known], np.array([r.vector for r in known]).reshape(len(known), model.directions.shape[1])
    kind = targets.schema["target"].dataType.simpleString()

    @F.pandas_udf(f"struct<target:{kind},cosine:double>")
    def nearest(words: pd.Series) -> pd.DataFrame:
        lists, found = words.tolist(), []
        for i in range(0, len(lists), BATCH):
            scores = np.round(vectors(model, lists[i : i + BATCH]) @ matrix.T, 9)
            at = scores.argmax(axis=1)
            found += list(zip([names[k] for k in at], scores[np.arange(len(at)), at]))
        return pd.DataFrame(found, columns=["target", "cosine"])

    if not names:
        return rows.select("*", F.lit(None).cast(kind).alias("target"), F.lit(None).cast("double").alias("cosine"))
    return rows.withColumn("_n", nearest(word_buckets(F.col(text), len(model.idf)))).select(*rows.columns, "_n.*")


# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
