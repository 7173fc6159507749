"""Benchmark decontamination with a broadcast set of hashed windows.

A window is ``n`` consecutive words of an item; an item of fewer words is
one window.  Windows are hashed by a rolling polynomial over hashes of
their words, and looked up only inside runs of words whose hashes may be an
item's.  Hits on the hash are verified by the words themselves before they
count.

The set is flat arrays, under 100 bytes a word, and broadcast only while the
items have at most ``max_words`` words and it takes at most ``max_bytes``;
beyond either bound the hashes of the same windows are joined by a shuffle
instead, a window's places dealt to ``SALTS`` tasks, and verified on the text
behind them, with equal results.

Defined results: null text has no words; a document without a hit has zeros
and an empty list; items without words never occur; an item without an id
hits words but is neither counted nor listed; rows that repeat a doc_id give
a row each; repeated items with one id count once, and rows of an item id
with different texts all count for it; an empty benchmark leaves all
documents clean.  Ids may hold commas: they are counted before they are joined.
Columns in ``keep`` may have any name; one named like a result column needs
``prefix`` for the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ALNUM_GAP, ALNUM_TABLE, ascii_lower, carried, named, schema_of, ship, small_batches, split_words

WINDOW = 10
MAX_WORDS = 2_000_000
#: Bytes that a worker may hold for the set of windows, and what a word takes beside its own bytes, at most.
MAX_BYTES = 200_000_000
WORD_BYTES = 64
#: Copies of an item window in the join by shuffle, so that the places of one frequent window are dealt to as many tasks.
SALTS = 8
_BASE = 0x9E3779B97F4A7C15

FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, items string, contaminated boolean, spans array<struct<first:long,last:long>>"


class WindowSet:
    """The windows of all items in flat arrays: about 50 bytes an item word beside the words themselves.

    ``text`` is every item's words in a row, ``starts`` the byte at which each
    begins.  For each window length there are the ascending hashes of its
    windows, the first word of each, and a run of owners (item numbers)
    behind it.  ``maybe`` is true at the low bits of every item word's hash.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], n: int):
        numbers: dict[str, int] = {}
        text, widths, names, at = bytearray(), [], [], 0
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # by length: hashes, first words, owners
        for item, words in items:
            if not words:
                continue
            text += b" ".join(words) + b" "
            widths.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
            names.append(_names(words))
            size = min(n, len(words))
            hashes = _rolled(names[-1], size)
            owner = -1 if item is None else numbers.setdefault(item, len(numbers))
            parts.setdefault(size, []).append((hashes, np.arange(at, at + len(hashes), dtype=np.int64), np.full(len(hashes), owner, dtype=np.int64)))
            at += len(words)
        self.text = bytes(text)
        self.starts = np.cumsum(np.concatenate([[0], *[w + 1 for w in widths]]), dtype=np.int64)
        self.items = pa.array(list(numbers), pa.string())
        self.maybe = np.zeros(1 << max(12, (8 * at).bit_length()), dtype=bool)
        for h in names:
            self.maybe[h & np.uint64(len(self.maybe) - 1)] = True
        self.lengths = {size: self._grouped(size, *map(np.concatenate, zip(*own))) for size, own in parts.items()}

    def _grouped(self, size: int, hashes: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hash, first word, bounds of owners) of each different window, and the owners."""
        order = np.argsort(hashes, kind="stable")
        hashes, first, owner = hashes[order], first[order], owner[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        for i in np.flatnonzero(~new).tolist():  # equal hashes are one window where their words are equal
            new[i] = self.window(first[i], size) != self.window(first[i - 1], size)
        many = len(self.items) + 1
        pairs = np.unique((np.cumsum(new) - 1) * many + owner + 1)
        bounds = np.searchsorted(pairs // many, np.arange(new.sum() + 1))
        return hashes[new], first[new].astype(np.uint32), bounds.astype(np.uint32), (pairs % many - 1).astype(np.int32)

    def window(self, first: int, size: int) -> bytes:
        return self.text[self.starts[first] : self.starts[first + size] - 1]

    @property
    def nbytes(self) -> int:
        arrays = [self.starts, self.maybe, self.items, *[a for own in self.lengths.values() for a in own]]
        return len(self.text) + sum(a.nbytes for a in arrays)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """(first word, length) of every verified window of one document, and the items they belong to."""
        names = _names(words)
        known = self.maybe[names & np.uint64(len(self.maybe) - 1)]
        found: list[tuple[int, int]] = []
        owners: list[np.ndarray] = []
        if not known.any():
            return found, []
        upto = np.concatenate(([0], np.cumsum(known)))
        for size, (hashes, first, bounds, own) in self.lengths.items():
            starts = np.flatnonzero(upto[size:] - upto[:-size] == size)
            if not len(starts):
                continue
            rolled = _rolled(names, size)[starts]
            left, right = np.searchsorted(hashes, rolled, side="left"), np.searchsorted(hashes, rolled, side="right")
            met = set()
            for i in np.flatnonzero(left < right).tolist():
                s = int(starts[i])
                here = b" ".join(words[s : s + size])
                same = [j for j in range(left[i], right[i]) if self.window(first[j], size) == here]
                met.update(same)
                if same:
                    found.append((s, size))
            owners += [own[bounds[j] : bounds[j + 1]] for j in met]
        every = np.unique(np.concatenate([*owners, np.zeros(0, dtype=np.int32)]))
        return found, self.items.take(pa.array(every[every >= 0])).to_pylist()


def _names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` numbers, by Horner's rule over the whole array."""
    n = len(ids) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(_BASE) + ids[i : i + n]
            out ^= out >> np.uint64(29)
    return out


def _summary(n_words: int, places: list[tuple[int, int]], items: list[str]) -> tuple:
    spans: list[list[int]] = []
    for first, size in sorted(places):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], first + size)
        else:
            spans.append([first, first + size])
    found = sorted(set(items))
    listed = ",".join(found)
    n_hit = sum(b - a for a, b in spans)
    return n_words, n_hit, len(found), hashlib.sha256(listed.encode()).hexdigest(), listed, n_hit > 0, spans


def item_words(benchmark: DataFrame, item_col: str, text_col: str, max_words: int, max_bytes: int = MAX_BYTES) -> Iterator[tuple[str | None, list[bytes]]] | None:
    """The items for the driver, or None if their set would pass ``max_words`` words or ``max_bytes`` bytes; both are counted first."""
    item, text = named(item_col).cast("string"), named(text_col)
    words = F.size(split_words(ascii_lower(text), ALNUM_GAP))
    size = F.octet_length(F.coalesce(text, F.lit(""))) + F.octet_length(F.coalesce(item, F.lit(""))) + WORD_BYTES * (words + 1)
    n, n_bytes = benchmark.agg(F.sum(words + 1), F.sum(size)).first()
    if (n or 0) > max_words or (n_bytes or 0) > max_bytes:
        return None
    rows = benchmark.select(item, text).filter(text.isNotNull()).toLocalIterator()
    return ((i, t.encode().translate(ALNUM_TABLE).split()) for i, t in rows)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_words: int = MAX_WORDS,
    max_bytes: int = MAX_BYTES,
    keep: tuple[str, ...] = (),
    remove_spans: bool = False,
    prefix: str = "",
) -> DataFrame:
    """One row a document with its hits.

    keep: other columns of docs to carry along.  remove_spans adds
    ``clean_text``, the text without the characters from the first to the
    last word of each span.  prefix stands before the names of the results.
    """
    ship(docs.sparkSession)
    items = item_words(benchmark, item_col, item_text_col, max_words, max_bytes)
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), *carried(docs, keep))
    schema = schema_of(own, FIELDS + (", clean_text string" if remove_spans else ""), keep, prefix)
    names = schema.fieldNames()

    def results(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        columns = [batch.column("doc_id")]
        for i, kind in enumerate(_TYPES):
            values = [r[i] for r in rows]
            columns.append(pa.array([[{"first": a, "last": b} for a, b in v] for v in values] if i == 6 else values, kind))
        if remove_spans:
            columns.append(pa.array([cut_words(t, r[6]) for t, r in zip(batch.column("text").to_pylist(), rows)], pa.string()))
        return pa.RecordBatch.from_arrays([*columns, *[batch.column(f"_k{i}") for i in range(len(keep))]], names=names)

    if items is None:
        joined = _with_hits(own, benchmark, n, item_col, item_text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                rows = []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                    words = (text or "").encode().translate(ALNUM_TABLE).split()
                    hits = [h for h in found or [] if words[h["first"] : h["first"] + h["size"]] == [w.encode() for w in h["window"]]]
                    rows.append(_summary(len(words), [(h["first"], h["size"]) for h in hits], [h["item"] for h in hits if h["item"] is not None]))
                yield results(batch, rows)

        return joined.mapInArrow(run, schema)

    windows = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = windows.value
        for batch in small_batches(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().translate(ALNUM_TABLE).split()
                rows.append(_summary(len(words), *table.hits(words)))
            yield results(batch, rows)

    return own.mapInArrow(look_up, schema)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]


def cut_words(text: str | None, spans: list) -> str | None:
    """Text without the bytes from the first to the last word of each span of word numbers."""
    if not text or not spans:
        return text
    raw = text.encode()
    blank = np.frombuffer(raw.translate(ALNUM_TABLE), dtype=np.uint8) == 32
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def _with_hits(own: DataFrame, benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """own with ``hits``, when the items outgrow a broadcast: places whose window hash is an item's, with the item's words to verify.

    A document's word sends one hash for each window length there is (n of
    them at most); words are shuffled for found windows only.
    """
    # Rows are known by id and text, which every evaluation of the input gives alike.
    own = own.withColumn("_row", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy")))
    items = benchmark.select(named(item_col).cast("string").alias("item"), split_words(ascii_lower(named(text_col)), ALNUM_GAP).alias("w")).filter(F.size("w") > 0)
    sizes = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(n)).alias("k")).distinct().collect())

    def rolled(df: DataFrame, name: str, wanted: list[int]) -> DataFrame:
        places = df.filter(F.size("w") > 0).select(name, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
        window = lambda k: F.slice("w", F.col("i"), k)
        each = [F.when(F.col("i") + (k - 1) <= F.size("w"), F.struct(F.lit(k).alias("size"), F.xxhash64(window(k)).alias("h"))) for k in wanted]
        return places.select(name, "w", "i", F.explode(F.array_compact(F.array(*each))).alias("g")).select(name, "i", "g.size", "g.h", F.slice("w", F.col("i"), F.col("g.size")).alias("window"))

    if sizes:
        own_size = F.least(F.size("w"), F.lit(n))
        parts = [rolled(items.filter(own_size == k), "item", [k]) for k in sizes]
        wanted = reduce(DataFrame.union, parts)
        got = rolled(own.select("_row", split_words(ascii_lower(F.col("text")), ALNUM_GAP).alias("w")), "_row", sizes).select("_row", (F.col("i") - 1).alias("first"), "size", "h")
        # A window may stand in very many documents: its places are dealt out by row, its items copied.
        got = got.withColumn("salt", F.pmod(F.xxhash64("_row", "first"), F.lit(SALTS)))
        wanted = wanted.select("size", "h", "item", "window").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        # Spark takes both sides, which are exploded, to be no larger than their tables, so it must not choose to broadcast one.
        hits = got.hint("merge").join(wanted, ["size", "h", "salt"])
    else:
        hits = own.limit(0).select("_row", F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit("").alias("item"), F.array(F.lit("")).alias("window"))
    found = hits.groupBy(F.col("_row").alias("_hit")).agg(F.collect_set(F.struct("first", "size", "item", "window")).alias("hits"))
    return own.join(found, F.col("_row").eqNullSafe(F.col("_hit")), "left").drop("_row", "_hit")
