"""Key phrases of documents by term weight: a stand-in for an embedding-based extractor, not its equal."""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyloom.functions.dictionaries import PHRASE_STOP_WORDS
from tallyloom.functions.text import char_prefix, fold_marks, tok
from tallyloom.operators import semantics

#: See key_phrases.
SAMPLED, KNOWN, SALTS = 10_000, 65_536, 1009


def content_words(text: Column, chars: int = 2000) -> Column:
    """The words of the first ``chars`` characters without stop words."""
    stop = F.array(*map(F.lit, PHRASE_STOP_WORDS))
    return F.filter(tok(fold_marks(char_prefix(text, chars))), lambda w: ~F.array_contains(stop, w))


def _phrases(words: str) -> Column:
    """All one- and two-word phrases of a column of words, repeats included."""
    less = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), less), F.slice(words, F.lit(2), less), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def _distinct(rows: DataFrame) -> DataFrame:
    """(phrase), once for each row that holds it."""
    return rows.select(F.explode(F.array_distinct(_phrases("w"))).alias("phrase"))


def _merged(rows: DataFrame) -> DataFrame:
    """(id, phrase, n) over all rows of an id."""
    return rows.select("id", F.explode(_phrases("w")).alias("phrase")).groupBy("id", "phrase").agg(F.count("*").cast("int").alias("n"))


def counted(words: str) -> Counter:
    """How often each one- and two-word phrase stands in words joined by spaces."""
    own = words.split()
    found = Counter(own)
    found.update([f"{a} {b}" for a, b in zip(own, own[1:])])
    return found


def leading(found: Counter, known: dict[str, int], docs: int, most: int) -> Iterator[tuple[str, int, int | None]]:
    """(phrase, n, df) of what can be among the ``most`` best: all phrases that are not known, and of the known ones the best with their ties."""
    common = []
    for phrase, n in found.items():
        df = known.get(phrase)
        if df is None:
            yield phrase, n, None
        else:
            common.append((n * math.log(docs / df), phrase, n, df))
    # Weights are rounded later, and by another logarithm: a margin, so that no tie is lost.
    line = sorted((c[0] for c in common), reverse=True)[most - 1] - 1e-5 if len(common) > most else -math.inf
    yield from (c[1:] for c in common if c[0] >= line)


def key_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 15, chars: int = 2000) -> DataFrame:
    """(id, phrase, n, weight, place): the ``most`` one- and two-word phrases of the first ``chars`` characters by count times ln(documents / documents with it).

    Up to ``KNOWN`` phrases that are frequent among some ``SAMPLED`` documents
    are counted over all documents first, which moves one row a phrase and
    task.  A document knows their weights by itself and passes on its best
    ones; each other phrase goes to its fellows once, to be counted, and back
    to its document.  Which phrases are known changes what is moved and not
    the result.  Rows of one id are one document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), content_words(F.col(text_col), chars).alias("w"))
    total = docs.count()
    again = rows.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias("i"))
    merged = None
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("i"))
        rows, merged = rows.join(again, same, "left_anti"), _merged(rows.join(again, same, "left_semi"))
    sample = _distinct(docs.sample(min(1.0, SAMPLED / max(total, 1)), 42).select(content_words(F.col(text_col), chars).alias("w")))
    often = sample.groupBy("phrase").agg(F.count("*").alias("c")).filter("c > 1").orderBy(F.desc("c"), "phrase").limit(KNOWN).select("phrase").collect()
    chosen = spark.createDataFrame(often, "phrase string")
    each = _distinct(rows) if merged is None else _distinct(rows).union(merged.select("phrase"))
    seen = each.join(F.broadcast(chosen), "phrase").groupBy("phrase").agg(F.count("*").alias("df")).collect()
    known = spark.sparkContext.broadcast({r.phrase: r.df for r in seen})

    def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("words").to_pylist()
                found = [(i, *p) for i, text in enumerate(texts) for p in leading(counted(text or ""), known.value, total, most)]
                row, phrase, n, df = zip(*found) if found else ((), (), (), ())
                salt = [0 if d is None else 1 + (at + i) % SALTS for i, d in zip(row, df)]
                ids = part.column("id").take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(phrase, pa.string()), pa.array(n, pa.int32()), pa.array(df, pa.int64()), pa.array(salt, pa.int32())], names=["id", "phrase", "n", "df", "salt"])

    schema = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("phrase string, n int, df bigint, salt int").fields])
    parts = rows.select("id", F.array_join("w", " ").alias("words")).mapInArrow(passed_on, schema)
    if merged is not None:
        both = merged.join(F.broadcast(spark.createDataFrame(seen, "phrase string, df bigint")), "phrase", "left")
        salt = F.when(F.col("df").isNull(), 0).otherwise(1 + F.pmod(F.hash("id"), F.lit(SALTS)))
        parts = parts.union(both.select("id", "phrase", "n", "df", salt.alias("salt")))
    # A known phrase has its count and needs none of its fellows: salts keep them from one task.
    df = F.coalesce("df", F.count("*").over(Window.partitionBy("phrase", "salt")))
    back = parts.select("id", "phrase", "n", df.alias("df")).repartition("id")
    weighed = back.withColumn("weight", F.round(F.col("n") * F.log(F.lit(total) / F.col("df")), 6))
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "phrase")
    ranked = weighed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return ranked.select("id", "phrase", F.col("n").cast("long").alias("n"), "weight", "place")


def picked(relevance: np.ndarray, alike: np.ndarray, most: int, diversity: float) -> list[int]:
    """Places by maximal marginal relevance: the most relevant first, then the best of relevance less likeness to what is picked; earlier places win ties."""
    chosen: list[int] = []
    nearest = np.full(len(relevance), -np.inf)
    score = np.round(relevance, 9)
    while len(chosen) < min(most, len(relevance)):
        at = int(score.argmax())
        chosen.append(at)
        nearest = np.maximum(nearest, alike[at])
        score = np.round((1 - diversity) * relevance - diversity * nearest, 9)
        score[chosen] = -np.inf
    return chosen


def diverse_phrases(docs: DataFrame, model: semantics.Model, id_col: str = "doc_id", text_col: str = "text", most: int = 15, diversity: float = 0.5, chars: int = 2000) -> DataFrame:
    """(id, phrase, relevance, place): up to ``most`` one- and two-word phrases near to the document's vector and far from each other.

    Each row is worked out by itself; its phrases are bounded by ``chars``.
    """
    buckets, weighed = len(model.idf), model.idf[:, None] * model.directions

    def unit(rows: np.ndarray) -> np.ndarray:
        norm = np.sqrt((rows * rows).sum(axis=-1, keepdims=True))
        return np.where(norm > 1e-9, rows / np.where(norm > 1e-9, norm, 1), 0.0)

    def bucket(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % buckets

    @F.pandas_udf("array<struct<phrase:string,relevance:double>>")
    def extract(words: pd.Series) -> pd.Series:
        out = []
        for own in words:
            own = [] if own is None else list(own)
            phrases = sorted({*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))})
            of = {w: weighed[bucket(w)] for w in set(own)}
            v = unit(np.array([sum(of[w] for w in p.split()) for p in phrases]).reshape(len(phrases), weighed.shape[1]))
            relevance = v @ unit(sum((of[w] for w in own), np.zeros(weighed.shape[1])))
            chosen = picked(relevance, v @ v.T, most, diversity)
            out.append([{"phrase": phrases[i], "relevance": round(float(relevance[i]), 6)} for i in chosen])
        return pd.Series(out)

    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(extract(content_words(F.col(text_col), chars))).alias("place", "p"))
    return rows.select("id", "p.phrase", "p.relevance", (F.col("place") + 1).alias("place"))


# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
