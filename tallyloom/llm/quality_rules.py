"""Quality rules: plain counts, and a hashed n-gram likelihood ratio of a trusted target against the raw corpus.

Two multinomials over ``BUCKETS`` hashed byte n-grams are counted: one over
all documents, one over the trusted ones.  A document's score is the mean,
over its n-grams, of log p_target - log p_raw, so length plays no part; it is
kept if the score is at least ``THRESHOLD`` and the counts pass.  Raw counts
are add-one smoothed; the target is smoothed towards the raw corpus with the
weight of ``PRIOR`` n-grams, so that a small target rejects little.  Ratios are held as whole micro-nats, so that sums do not
depend on how rows are batched and every verdict is reproducible.

The target is a sample of labelled rows: the ``trusted_limit`` trusted ids
that come first by hash.  The raw counts cover all documents.

Columns in ``keep`` may have any name; one named like a result column needs
``prefix`` for the results.

Defined results: null text has no words and fails; a text shorter than an
n-gram scores 0; without trusted documents all scores are 0 and only the
counts decide; rows that repeat a doc_id are judged each on their own text;
an empty table gives an empty result.

Scale: two scans and no shuffle of text; the counts have a fixed number of
buckets, so what each task sends and what is broadcast is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import named, schema_of, ship, small_batches

N = 3
BUCKETS = 1 << 16
#: Nats an n-gram, on average, by which a document may be less likely under the target.
THRESHOLD = -0.5
TRUSTED_LIMIT = 20_000
PRIOR = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows judged at once.
ROWS = 1_000
#: Text bytes hashed at once.
SLICE = 500_000

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\v\f\r"
_MIX = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of slices of a string column, nulls empty."""
    if not len(column):
        return
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _buckets(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and whether that n-gram lies within one text."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    h = np.zeros(size, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(n):
            h += data[i : i + size].astype(np.uint32) * np.uint32(_MIX[i])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(16)
    inside = np.ones(size, dtype=bool)
    for back in range(1, n):
        at = offsets[1:] - back
        inside[at[(at >= 0) & (at < size)]] = False
    return (h % np.uint32(buckets)).astype(np.int64), inside


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT, id_col: str = "doc_id", quality_col: str = "quality") -> list:
    """The ids of trusted rows that come first by hash, ``limit`` at most."""
    trusted = labels.filter(F.col(quality_col) == 1).select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    return [r[0] for r in trusted.orderBy(F.xxhash64("id"), "id").limit(limit).collect()]


def likelihood_ratios(docs: DataFrame, trusted: list, n: int = N, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Micro-nats of log p_target / p_raw for each bucket."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(trusted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), dtype=np.int64)
        ids = None
        for batch in batches:
            if ids is None:
                ids = pa.array(known.value, batch.column("id").type)
            chosen = pc.fill_null(pc.is_in(batch.column("id"), value_set=ids), False).to_numpy(zero_copy_only=False)
            for row, data, offsets in _texts(batch.column("text")):
                bucket, inside = _buckets(data, offsets, n, buckets)
                sums[0] += np.bincount(bucket[inside], minlength=buckets)
                own = chosen[row : row + len(offsets) - 1]
                if own.any():
                    inside &= np.repeat(own, np.diff(offsets))[: len(inside)]
                    sums[1] += np.bincount(bucket[inside], minlength=buckets)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["bucket", "raw", "target"])

    parts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(count, "bucket long, raw long, target long")
    sums = np.zeros((2, buckets))
    found = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # ``buckets`` rows at most
    at = found["bucket"].to_numpy()
    sums[0, at], sums[1, at] = found["raw"].to_numpy(), found["target"].to_numpy()
    if not sums[1].any():
        return np.zeros(buckets, dtype=np.int64)
    raw = (sums[0] + 1) / (sums[0].sum() + buckets)
    target = (sums[1] + PRIOR * raw) / (sums[1].sum() + PRIOR)
    return np.round(np.log(target / raw) * 1e6).astype(np.int64)


def plain_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, word characters, symbols, repeated lines, words in repeated 3-word windows)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, _BLANKS))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated


def judge(
    docs: DataFrame,
    trusted: list,
    n: int = N,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    prefix: str = "",
) -> DataFrame:
    """One row a document: the plain counts, base_failed, score (nats an n-gram), kept, each with ``prefix``, and the columns in ``keep``."""
    ratios = docs.sparkSession.sparkContext.broadcast(likelihood_ratios(docs, trusted, n, buckets, id_col, text_col))
    limit = round(threshold * 1e6)
    # The text is sent to Python once, also where it is kept.
    sent = ["text" if c == text_col else f"_k{i}" for i, c in enumerate(keep)]
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), *[named(c).alias(x) for c, x in zip(keep, sent) if x != "text"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = ", ".join(f"{x} long" for x in names) + ", base_failed boolean, score double, kept boolean"
    schema = schema_of(own.select("*", *[F.col("text").alias(f"_k{i}") for i, x in enumerate(sent) if x == "text"]), fields, keep, prefix)
    out_names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for batch in small_batches(batches, ROWS):
            column = batch.column("text")
            sums = np.zeros(len(column), dtype=np.int64)
            grams = np.zeros(len(column), dtype=np.int64)
            for row, data, offsets in _texts(column):
                bucket, inside = _buckets(data, offsets, n, buckets)
                for values, out in ((table[bucket] * inside, sums), (inside, grams)):
                    upto = np.concatenate(([0], np.cumsum(values)))
                    place = np.minimum(offsets, len(bucket))
                    out[row : row + len(offsets) - 1] = upto[place[1:]] - upto[place[:-1]]
            counts = np.array([plain_counts(t.as_py()) for t in column], dtype=np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            kept = ~failed & (sums >= limit * grams)
            score = sums / np.maximum(grams, 1) / 1e6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[:, i]) for i in range(5)], pa.array(failed), pa.array(score), pa.array(kept), *[batch.column(x) for x in sent]],
                names=out_names,
            )

    return own.mapInArrow(run, schema)
