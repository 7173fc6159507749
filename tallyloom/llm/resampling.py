"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its runs of 1 to ``order`` words, repeats counted; a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``.  A bucket's
gain is the smoothed log ratio of the target's and the corpus's share, in
thousandths, floored.  A document's weight is the sum of its features' gains;
Gumbel noise from a hash of its id makes the highest scores a draw without
replacement in proportion to exp(weight).

Method: within a batch the n-grams are interned in an open-addressed NumPy
table.  Keys are XXH64 of the bytes, probing is linear, and an occurrence
joins a slot only if its bytes equal those of the slot's first occurrence.
A slot stores bucket and count; an occurrence keeps its slot id, by which
gains are gathered.

Two scans of the text: one sums slot counts by bucket (``buckets`` numbers a
task, summed by Spark; the driver gets that many at most), one gathers
gains.  Nothing of a text is shuffled.  Ranks come from a range partition of
the scores with repeated rows kept apart by a row number, so no task orders
more than its range, and rows below the draw are not ranked at all.

Defined results: null and empty texts and those without a word have no
features, weight 0 and a score from noise alone; texts of any length are
counted whole, in runs of ``RUN_WORDS`` words; equal scores rank by smaller
doc_id, nulls last; repeated rows are documents of their own, with equal
scores and ranks that follow each other; a null doc_id takes its noise from
``<seed>:``; an empty table gives an empty result, an empty target gains
that fall with a bucket's corpus count.  Other columns are dropped unless in
``keep``; results take ``prefix`` before their names, so a kept column may
have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import ALNUM_TABLE, carried, named, schema_of, ship, small_batches, written

ORDER = 3
BUCKETS = 10_000
#: Documents with fewer words are never drawn.
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Words whose n-grams are interned at once.
RUN_WORDS = 100_000
#: Keys of longer n-grams, or of lengths that few share, are made one by one.
LANE_BYTES = 64
FEW = 24

_M = (1 << 64) - 1
#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(state: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(state + lane * _P2, 31) * _P1


@cache
def _byte_table() -> np.ndarray:
    """CRC-32 of each byte, by its polynomial (reversed, 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (c & np.uint32(1)) * np.uint32(0xEDB88320)
    return c


@cache
def _crc_table() -> np.ndarray:
    """The same for each pair of bytes, the low byte first."""
    c = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        c = _byte_table()[c & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return c


class Words:
    """Words of a batch of texts: ``data`` has each one followed by a blank, so every run of words of one text is a slice of it."""

    def __init__(self, texts: list[bytes | None]):
        joined = b" ".join([t or b"" for t in texts]) + b" "
        raw = np.frombuffer(joined.translate(ALNUM_TABLE), dtype=np.uint8)
        inside = raw != 32
        behind = np.empty_like(inside)
        behind[0] = False
        behind[1:] = inside[:-1]
        self.data = raw[inside | behind].copy()
        ends = np.flatnonzero(self.data == 32)
        self.ends = ends
        self.starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        first = np.flatnonzero(inside & ~behind)
        begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        #: The first word of each text, and the number of words behind the last one.
        self.bounds = np.searchsorted(first, begins)

    def grams(self, a: int, z: int, order: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, length) of the runs of up to ``order`` words that begin at words a to z; last: the end word of each word's text."""
        at = np.arange(a, z)
        words, starts, ends = [], [], []
        for k in range(order):
            fits = at if k == 0 else at[at + k < last[a:z]]
            words.append(fits)
            starts.append(self.starts[fits])
            ends.append(self.ends[fits + k])
        start = np.concatenate(starts)
        return np.concatenate(words), start, np.concatenate(ends) - start


class NgramTable:
    """Byte strings of one buffer, interned: ``slot`` of each occurrence, and ``first``, ``bucket`` and ``count`` of each used slot.

    keys may be given to force collisions; otherwise they are XXH64 of the bytes.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int = BUCKETS, keys: np.ndarray | None = None):
        self.data = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        #: The eight bytes from each place on.
        self.lanes = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,)).copy()
        self.raw = self.data.tobytes()
        self.starts, self.lengths = starts, lengths
        n = len(starts)
        self.keys = self._each(np.arange(n), self._xxh64, xxhash.xxh64_intdigest) if keys is None else keys
        size = 1 << max(4, (2 * n - 1).bit_length() if n else 0)
        self.held = np.full(size, -1, dtype=np.int64)
        self.slot = self._intern(size)
        used = np.flatnonzero(self.held >= 0)
        first = self.held[used]
        self.bucket = np.zeros(size, dtype=np.int64)
        self.bucket[used] = self._each(first, self._crc, zlib.crc32).astype(np.int64) % buckets
        self.count = np.bincount(self.slot, minlength=size)
        self.used = used

    def _each(self, rows: np.ndarray, many: Callable, one: Callable) -> np.ndarray:
        """A hash of each of these occurrences: ``many`` takes the places of one length and that length, ``one`` bytes."""
        starts, lengths = self.starts[rows], self.lengths[rows]
        out = np.empty(len(rows), dtype=np.uint64)
        # Lengths of LANE_BYTES or more are one group; small numbers sort fastest.
        group = np.minimum(lengths, LANE_BYTES).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        counts = np.bincount(group, minlength=LANE_BYTES + 1)
        for size, j in enumerate(np.cumsum(counts).tolist()):
            own = order[j - counts[size] : j]
            if size == LANE_BYTES or len(own) <= FEW:
                out[own] = [one(self.raw[s : s + m]) for s, m in zip(starts[own].tolist(), lengths[own].tolist())]
            else:
                out[own] = many(starts[own], size)
        return out

    def _crc(self, s: np.ndarray, size: int) -> np.ndarray:
        """CRC-32, two bytes at a time."""
        table = _crc_table()
        c = np.full(len(s), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, size - 1, 2):
            c = table[(c ^ self.lanes[s + at].astype(np.uint32)) & np.uint32(0xFFFF)] ^ (c >> np.uint32(16))
        if size % 2:
            c = _byte_table()[(c ^ self.data[s + size - 1]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        return c ^ np.uint32(0xFFFFFFFF)

    def _xxh64(self, s: np.ndarray, size: int) -> np.ndarray:
        lanes, at = self.lanes, 0
        with np.errstate(over="ignore"):
            if size >= 32:
                states = [_P1 + _P2, _P2, np.uint64(0), np.uint64(-int(_P1) & _M)]
                while at + 32 <= size:
                    states = [_round(v, lanes[s + (at + 8 * i)]) for i, v in enumerate(states)]
                    at += 32
                h = sum(_turn(v, r) for v, r in zip(states[1:], (7, 12, 18))) + _turn(states[0], 1)
                for v in states:
                    h = (h ^ _round(np.uint64(0), v)) * _P1 + _P4
            else:
                h = np.full(len(s), _P5, dtype=np.uint64)
            h = h + np.uint64(size)
            while at + 8 <= size:
                h = _turn(h ^ _round(np.uint64(0), lanes[s + at]), 27) * _P1 + _P4
                at += 8
            if at + 4 <= size:
                h = _turn(h ^ (lanes[s + at] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
                at += 4
            while at < size:
                h = _turn(h ^ self.data[s + at].astype(np.uint64) * _P5, 11) * _P1
                at += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            return h ^ (h >> np.uint64(32))

    def _intern(self, size: int) -> np.ndarray:
        """The slot of each occurrence: free slots are claimed, taken ones compared, the rest probe on."""
        mask = size - 1
        out = np.empty(len(self.starts), dtype=np.int64)
        probe = (self.keys & np.uint64(mask)).astype(np.int64)
        pending = np.arange(len(out))
        while len(pending):
            held = self.held[probe]
            free = held < 0
            # Of several that claim one slot the last written stays; the others meet it below.
            self.held[probe[free]] = pending[free]
            held = self.held[probe]
            same = held == pending
            other = np.flatnonzero(~same)
            same[other] = self._equal(held[other], pending[other])
            out[pending[same]] = probe[same]
            pending, probe = pending[~same], (probe[~same] + 1) & mask
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of occurrences a and b are equal; keys and lengths first, then eight bytes at a time."""
        same = (self.keys[a] == self.keys[b]) & (self.lengths[a] == self.lengths[b])
        left = np.flatnonzero(same)
        x, y, rest = self.starts[a[left]], self.starts[b[left]], self.lengths[a[left]]
        for _ in range(LANE_BYTES // 8):
            if not len(left):
                return same
            spare = np.uint64(8) * (8 - np.minimum(rest, 8)).astype(np.uint64)
            equal = ((self.lanes[x] ^ self.lanes[y]) << spare) == 0
            same[left[~equal]] = False
            on = equal & (rest > 8)
            left, x, y, rest = left[on], x[on] + 8, y[on] + 8, rest[on] - 8
        for i, s, t, m in zip(left.tolist(), x.tolist(), y.tolist(), rest.tolist()):
            same[i] = self.raw[s : s + m] == self.raw[t : t + m]
        return same


def _runs(words: Words, order: int, buckets: int) -> Iterator[tuple[np.ndarray, NgramTable]]:
    """(first word of each occurrence, its table) for runs of RUN_WORDS words; n-grams may reach into the next run."""
    total = len(words.starts)
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))
    for a in range(0, total, RUN_WORDS):
        z = min(a + RUN_WORDS, total)
        word, start, length = words.grams(a, z, order, last)
        low, high = words.starts[a], words.ends[min(z + order, total) - 1] + 1
        yield word, NgramTable(words.data[low:high], start - low, length, buckets)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``text``."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in small_batches(batches):
            for _, table in _runs(Words(_bytes(batch.column("text"))), order, buckets):
                total += np.bincount(table.bucket[table.used], weights=table.count[table.used], minlength=buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in sums.toLocalIterator():  # one row a bucket
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the corpus, by bucket."""
    n, m, k = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [(float(t + 1) * float(n + k)) / (float(s + 1) * float(m + k)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """(doc_id, n_words, n_features, weight, kept columns) of each row."""
    ship(docs.sparkSession)
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), *carried(docs, keep))
    schema = schema_of(own, "n_words long, n_features long, weight long", keep, prefix)
    names = [f.name for f in schema.fields]
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = Words(_bytes(batch.column("text")))
            per_word = np.zeros(len(words.starts) + 1, dtype=np.int64)
            for word, table in _runs(words, order, buckets):
                of_slot = gain[table.bucket]
                per_word[:-1] += np.bincount(word, weights=of_slot[table.slot], minlength=len(words.starts)).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(per_word[:-1])))
            n = np.diff(words.bounds)
            features = sum(np.maximum(n - k, 0) for k in range(order))
            weight = upto[words.bounds[1:]] - upto[words.bounds[:-1]]
            kept = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64()), *kept], names=names)

    return own.mapInArrow(weigh, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
    prefix: str = "",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank, kept columns) of each row; rank is null if the row is not drawn.

    target: rows with the column ``text_col``, whose distribution is aimed at.
    """
    spark = docs.sparkSession
    gain = gains(*(bucket_counts(rows.select(named(text_col).alias("text")), order, buckets) for rows in (docs, target)))
    p = prefix
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(code, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(u)))
    row_no = f"{p}row"  # tells repeated rows apart
    scored = weights(docs, gain, order, id_col, text_col, keep, p).withColumn(f"{p}score", (F.col(f"{p}weight") + noise).cast("long"))
    scored = written(scored.withColumn(row_no, F.monotonically_increasing_id()), "scores")
    able = F.col(f"{p}n_words") >= min_words
    order_by = [F.desc(f"{p}score"), F.asc_nulls_last("doc_id"), F.asc(row_no)]
    part = f"{p}part"
    ranged = written(scored.filter(able).repartitionByRange(*order_by).withColumn(part, F.spark_partition_id()), "score-ranges")
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())  # one row a partition
    drawn = sum(n for _, n in sizes) * percent // 100
    before, upto = {}, 0
    for no, n in sizes:
        if upto < drawn:
            before[no] = upto
        upto += n
    offsets = spark.createDataFrame(list(before.items()), f"`{part}` int, `{p}before` long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order_by)) + F.col(f"{p}before")
    top = ranged.join(F.broadcast(offsets), part).withColumn(f"{p}rank", F.when(place <= drawn, place).cast("long"))
    none = F.lit(None).cast("long").alias(f"{p}rank")
    columns = ["doc_id", *[f"{p}{c}" for c in ("n_words", "n_features", "weight", "score", "rank")], *keep]
    rest = ranged.filter(~F.col(part).isin(list(before)) if before else F.lit(True))
    shown = [named(c) for c in columns]
    return top.select(*shown).unionAll(rest.withColumn(f"{p}rank", none).select(*shown)).unionAll(scored.filter(~able).withColumn(f"{p}rank", none).select(*shown))
