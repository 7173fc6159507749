"""Linear text classifiers on hashed words, trained in full-batch steps whose gradients Spark sums.

A row's words are hashed into ``buckets`` features, each word adding
1 / sqrt(words of the row).  One label a row is learned by softmax and
cross-entropy, with rows weighted by class; several by a sigmoid each and
binary cross-entropy, with positives weighted.  Each step is one Spark job:
tasks sum gradients over their training rows and, with the same weights,
losses and hits over their validation rows.  The driver holds the weights
(labels times buckets), moves them by Adam with decoupled weight decay, and
stops once the validation measure has not risen for ``patience`` steps,
keeping the best weights.

Scale: rows are hashed and written once, as arrays of bucket numbers; a task
sends no more than labels times buckets sums, which are added by key before
one row a feature reaches the driver.

Defined results: texts without words have the bias alone; rows without a
label, or with one that is not learned, are left out; labels without rows
count once in the class weights; without validation rows all steps are taken.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import tok

BUCKETS = 4096
#: Keys of what is summed beside the gradient: training weight and loss, validation rows, loss and hits.
WEIGHT, LOSS, SEEN, HELD_LOSS, HITS = -1, -2, -3, -4, -5


def word_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each word of a text in lower case: the first eight hex digits of its MD5, modulo ``buckets``."""
    number = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")
    return F.transform(tok(F.lower(F.coalesce(text, F.lit("")))), lambda w: (number(w) % buckets).cast("int"))


@dataclass
class Model:
    labels: list[str]
    buckets: int
    multi: bool
    #: One row a label: a weight a bucket, and the bias last.
    weights: np.ndarray
    history: list[dict] = field(default_factory=list)


def _rows_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word of a batch."""
    offsets = lists.offsets.to_numpy()
    buckets = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return buckets.astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(offsets))


def scores(weights: np.ndarray, buckets: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score of each of n rows for each label, value of each word)."""
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
    return np.stack([np.bincount(row, weights=w[buckets] * value, minlength=n) + w[-1] for w in weights], axis=1), value


def losses(z: np.ndarray, wanted: np.ndarray, label_weights: np.ndarray, multi: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss of each row, its derivative by the scores, the weight of each row)."""
    if multi:
        p = 1 / (1 + np.exp(-z))
        each = label_weights * wanted * np.logaddexp(0, -z) + (1 - wanted) * np.logaddexp(0, z)
        slope = (1 - wanted) * p - label_weights * wanted * (1 - p)
        k = z.shape[1]
        return each.mean(axis=1), slope / k, np.ones(len(z))
    top = z.max(axis=1, keepdims=True)
    log_sum = top[:, 0] + np.log(np.exp(z - top).sum(axis=1))
    weight = wanted @ label_weights
    return weight * (log_sum - (z * wanted).sum(axis=1)), weight[:, None] * (np.exp(z - log_sum[:, None]) - wanted), weight


def summed(rows: DataFrame, weights: np.ndarray, label_weights: np.ndarray, multi: bool) -> tuple[np.ndarray, dict[int, float]]:
    """(sum of the gradients of the training rows, other sums by key) for rows (words, wanted, held)."""
    shape = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, other = np.zeros(shape), dict.fromkeys((WEIGHT, LOSS, SEEN, HELD_LOSS, HITS), 0.0)
        for batch in batches:
            n = batch.num_rows
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            wanted = batch.column("wanted").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, shape[0])
            buckets, row = _rows_of(batch.column("words"))
            z, value = scores(weights, buckets, row, n)
            loss, slope, weight = losses(z, wanted, label_weights, multi)
            right = ((z > 0) == (wanted > 0)).all(axis=1) if multi else z.argmax(axis=1) == wanted.argmax(axis=1)
            slope[held] = 0
            for k in range(shape[0]):
                gradient[k, :-1] += np.bincount(buckets, weights=slope[row, k] * value, minlength=shape[1] - 1)
                gradient[k, -1] += slope[:, k].sum()
            for key, sums in ((WEIGHT, weight[~held]), (LOSS, loss[~held]), (SEEN, held), (HELD_LOSS, loss[held]), (HITS, right[held])):
                other[key] += float(sums.sum())
        flat = gradient.ravel()
        at = np.flatnonzero(flat)
        keys = np.concatenate((at, np.array(list(other))))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate((flat[at], list(other.values()))))], names=["k", "v"])

    sums = rows.select("words", "wanted", "held").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    gradient, other = np.zeros(weights.size), dict.fromkeys((WEIGHT, LOSS, SEEN, HELD_LOSS, HITS), 0.0)
    for k, v in sums.toLocalIterator():  # a row a feature
        if k < 0:
            other[k] = v
        else:
            gradient[k] = v
    return gradient.reshape(shape), other


class Adam:
    """Moves weights against their gradient, with decoupled decay."""

    def __init__(self, rate: float, decay: float):
        self.rate, self.decay, self.step, self.mean, self.square = rate, decay, 0, 0.0, 0.0

    def moved(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient**2
        mean, square = self.mean / (1 - 0.9**self.step), self.square / (1 - 0.999**self.step)
        return weights - self.rate * (mean / (np.sqrt(square) + 1e-8) + self.decay * weights)


def class_weights(rows: DataFrame, labels: list[str], multi: bool) -> np.ndarray:
    """total / (labels * count) of the training rows, or negatives / positives of each label if a row may have several; counts of zero are one."""
    own = rows.filter(~F.col("held"))
    found = own.select(F.explode("of").alias("label")).groupBy("label").count().filter(F.col("label").isin(labels))
    counts = dict(found.collect())  # a row a label
    n = np.maximum([counts.get(label, 0) for label in labels], 1).astype(float)
    total = own.count()
    return np.maximum(total - n, 0) / n if multi else n.sum() / (len(labels) * n)


def prepared(rows: DataFrame, labels: list[str], multi: bool, buckets: int = BUCKETS) -> DataFrame:
    """(words, of, wanted, held) of rows (text, label or labels array, fold); ``held`` for the fold ``test``."""
    of = F.array_distinct(F.filter(F.col("label") if multi else F.array("label"), lambda x: x.isin(labels)))
    wanted = F.array(*[F.array_contains("of", label).cast("double") for label in labels])
    rows = rows.select(word_buckets(F.col("text"), buckets).alias("words"), of.alias("of"), (F.col("fold") == "test").alias("held"))
    return rows.filter(F.col("of").isNotNull() if multi else F.size("of") > 0).select("words", "of", wanted.alias("wanted"), "held")


def train(
    rows: DataFrame,
    labels: list[str],
    keep: Callable[[DataFrame], DataFrame],
    multi: bool = False,
    buckets: int = BUCKETS,
    steps: int = 60,
    rate: float = 0.3,
    decay: float = 0.001,
    patience: int = 2,
    every: int = 5,
) -> Model:
    """Train on rows (text, label, fold); ``label`` is an array if ``multi``.

    ``keep`` stores the hashed rows and reads them back, as every step
    reads them.  The validation measure, hits among the rows of fold
    ``test``, is looked at ``every`` so many steps.
    """
    stored = keep(prepared(rows, labels, multi, buckets))
    label_weights = class_weights(stored, labels, multi)
    model = Model(labels, buckets, multi, np.zeros((len(labels), buckets + 1)))
    best, best_hits, waited, adam = model.weights, (-1.0, 0.0), 0, Adam(rate, decay)
    for step in range(steps + 1):
        gradient, sums = summed(stored, model.weights, label_weights, multi)
        weight, seen = max(sums[WEIGHT], 1e-12), max(sums[SEEN], 1.0)
        model.history.append({"step": step, "loss": sums[LOSS] / weight, "held_loss": sums[HELD_LOSS] / seen, "hits": sums[HITS] / seen})
        if step % every == 0 or step == steps:
            hits = (sums[HITS] / seen, -sums[HELD_LOSS] / seen)
            if hits > best_hits or not sums[SEEN]:
                best, best_hits, waited = model.weights, hits, 0
            else:
                waited += 1
                if waited >= patience:
                    break
        if step < steps:
            model.weights = adam.moved(model.weights, gradient / weight)
    model.weights = best
    return model


def predict(model: Model, rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with ``predicted`` (a label, or an array of those over one half) and ``confidence`` (of the best label)."""
    weights, labels, multi = model.weights, model.labels, model.multi

    kind = "array<string>" if multi else "string"

    @F.pandas_udf(f"struct<predicted:{kind},confidence:double>")
    def judge(words: pd.Series) -> pd.DataFrame:
        lists = [np.asarray(w, dtype=np.int64) for w in words]
        row = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
        z, _ = scores(weights, np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64), row, len(lists))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = 1 / (1 + np.exp(-z)) if multi else e / e.sum(axis=1, keepdims=True)
        called = [[labels[k] for k in np.flatnonzero(r > 0.5)] for r in p] if multi else [labels[k] for k in p.argmax(axis=1)]
        return pd.DataFrame({"predicted": called, "confidence": p.max(axis=1)})

    return rows.withColumn("_j", judge(word_buckets(F.col(text), model.buckets))).select(*rows.columns, "_j.*")


# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
