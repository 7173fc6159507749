"""Removal of repeated byte strings by sparse, distributed prefix doubling.

A byte goes if a ``length``-byte string that covers it also starts earlier,
in a smaller doc_id or earlier in the same document.  Ranks are names of
equal strings; a position whose rank is unique is dropped, the rest get the
rank of a longer string, until ``length`` is reached:

1.  Rank at ``SEED`` bytes.  Only winnowed positions start (the least seed
    hash of each stretch of length - SEED + 1 seeds): equal strings of
    ``length`` bytes choose the same position inside, so none is lost and a
    thirtieth of all positions is shuffled and sorted.  Unique ranks drop out.
2.  Rank pair (seed, context), context being all bytes that any
    ``length``-byte string around the seed can reach.  An occurrence whose
    pair also stands earlier is repeated throughout: its whole context goes
    without looking at single positions.  Tasks do this for their own rows
    before the shuffle, so copies and common passages leave few rows.
3.  What is left are first occurrences of different contexts of one seed, the
    edges of repeated passages.  All their positions are ranked at half the
    length, unique ones drop out, and the sorted pairs of ranks (at s, at
    s + length/2) give the ranks at full length; each but the first of a rank
    is a repeat.

Hot seeds, such as a line that stands in a third of all documents, are never
kept in one group.  A first scan finds them by lossy counting (``hot_seeds``);
they are grouped by seed and context in step 2, and they and others with more
than ``HOT_CONTEXTS`` contexts have their positions dealt out by the name of
their string in step 3, where those that repeat another of the same batch are
settled before the shuffle.  Both ways give the same result.  So no group of
step 2 has more rows than ``HOT_ROWS``, a ``SHARE``-th of all positions, or two
a batch of ``BUFFER`` bytes, whichever is most.

Names are pairs of 64-bit hashes, 128 bits in all: seed and context, half
string and seed, or two names of one string.

Defined results: null text is empty; texts shorter than ``length`` keep all
bytes; rows that repeat a doc_id and text do not precede each other and get
equal results; rows that share only the doc_id follow each other by start and
then by the hash of their text; null doc_ids come first; an empty table gives
an empty result.  ``clean_text`` leaves out a character that was cut within.
Columns in ``keep`` may have any name; one named like a result column needs
``prefix`` for the results.

Scale: text is read three times and shuffled once by document; other shuffles
hold a few numbers for each winnowed position or the context of an edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyloom.llm.common import carried, named, schema_of, ship, small_batches, written

LENGTH = 100
SEED = 32
HOT_CONTEXTS = 1024
#: Contexts whose positions are ranked at once; a seed is never parted.
CONTEXTS_AT_ONCE = 3_000
#: A seed is hot with more positions than HOT_ROWS and than a SHARE-th of all.
HOT_ROWS = 4096
SHARE = 1 << 17
#: What is known of a winnowed position: nothing, that it repeats another of its task, or that its seed is hot.
OPEN, DONE, HOT = 0, 1, 2
#: What judged positions and the rows around them are.
REPEATED, EDGE, HOT_EDGE = 0, 1, 2
#: Bytes of text that a task winnows before it sends on what it found.
BUFFER = 12_000_000

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = int(_rng.integers(0, 2**63)) * 2 + 1
_BACK = pow(_STEP, -1, 2**64)
_BYTE_2 = _rng.integers(0, 2**64, 256, dtype=np.uint64)


class _Powers:
    """Powers of a number modulo 2**64, extended when a longer text comes."""

    def __init__(self, base: int):
        self.base = base
        self.values = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            while len(self.values) < n:
                k = len(self.values)
                self.values = np.concatenate((self.values, self.values * np.uint64(pow(self.base, k, 2**64))))
        return self.values[:n]


_UP, _DOWN = _Powers(_STEP), _Powers(_BACK)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x7FB5D329728EA185)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _prefix_sums(raw: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[raw] * _UP.upto(len(raw)), out=sums[1:])
    return sums


def _names(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings from starts to ends."""
    with np.errstate(over="ignore"):
        return _mixed((sums[ends] - sums[starts]) * _DOWN.upto(len(sums))[starts])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``width`` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def winnow(raw: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, seed names, context names) of one text of ``length`` bytes or more."""
    n = len(raw)
    sums = _prefix_sums(raw)
    with np.errstate(over="ignore"):
        seeds = _mixed((sums[seed:] - sums[:-seed]) * _DOWN.upto(n - seed + 1))
    width = length - seed + 1
    least = _sliding(seeds, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    bound = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    at = np.flatnonzero(seeds == bound)
    lo, hi = np.maximum(at + seed - length, 0), np.minimum(at + length, n)
    # Where a context is cut short by the text's start or end is part of its name.
    with np.errstate(over="ignore"):
        place = _mixed(((at - lo) << 32 | (hi - at)).astype(np.uint64))
        context = _mixed(_names(sums, lo, hi) + place)
    return at, seeds[at], context


def _texts_of(length: int, found: Callable[[list[tuple], pa.DataType], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that gathers (doc_id, copy, bytes) of texts of ``length`` bytes or more and hands on ``BUFFER`` bytes at a time, by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        id_type = pa.null()
        for batch in small_batches(batches):
            id_type = batch.schema.field("doc_id").type
            for doc_id, copy, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "copy", "text")]):
                raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
                if len(raw) < length:
                    continue
                rows.append((doc_id, copy, raw))
                held += len(raw)
                if held >= BUFFER:
                    yield from found(sorted(rows, key=_by_id), id_type)
                    rows, held = [], 0
        if rows:
            yield from found(sorted(rows, key=_by_id), id_type)

    return run


def _by_id(row: tuple) -> tuple:
    return row[0] is not None, row[0]


class Winnowed:
    """The winnowed positions of some texts: arrays owner, at, g and c, and which of them repeat another, earlier one of these."""

    def __init__(self, rows: list[tuple], length: int, seed: int):
        found = [winnow(raw, length, seed) for _, _, raw in rows]
        self.at, self.g, self.c = (np.concatenate([f[k] for f in found]) for k in range(3))
        self.owner = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
        ids = [r[0] for r in rows]
        own_id = np.cumsum([0] + [a != b for a, b in zip(ids[1:], ids)])[self.owner]
        copy = np.array([r[1] for r in rows], dtype=np.int64)[self.owner]
        with np.errstate(over="ignore"):
            both = _mixed(self.g) + self.c
        # Texts under one id mix their positions; else the order of rows is that of (doc_id, place).
        order = np.argsort(both, kind="stable") if len(set(ids)) == len(ids) else np.lexsort((copy, self.at, own_id, both))
        new = np.concatenate(([True], both[order][1:] != both[order][:-1]))
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        self.done = np.zeros(len(order), dtype=bool)
        self.done[order] = (self.at[order] != self.at[first]) | (own_id[order] != own_id[first]) | (copy[order] != copy[first])


def hot_seeds(docs: DataFrame, length: int, seed: int, hot_rows: int, share: int = SHARE) -> np.ndarray:
    """Names of the seeds that stand far more often than others, sorted: lossy counting.

    Of a batch of N positions only seeds with ``N / (2 * share)`` places, two at
    least, are sent on, so little is shuffled and a sum falls short by less than
    that a batch (``missed`` in all).  Every seed with more places than T, the most
    of ``hot_rows``, a ``share``-th of all and twice ``missed``, is found; what is
    found has more than half of T, so there are ``2 * share`` seeds at most.
    """

    def count(rows: list[tuple], _: pa.DataType) -> Iterator[pa.RecordBatch]:
        some = Winnowed(rows, length, seed)
        g, n = np.unique(some.g[~some.done], return_counts=True)
        total = int(n.sum())
        least = max(2, -(-total // (2 * share)))
        often = n >= least
        yield from _sliced(
            pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(g[often].view(np.int64)), pa.nulls(1, pa.int64())]),
                    pa.array(np.append(n[often], total)),
                    pa.array(np.append(np.zeros(often.sum(), dtype=np.int64), least - 1)),
                ],
                names=["g", "n", "missed"],
            )
        )

    sent = docs.select("doc_id", "copy", "text").mapInArrow(_texts_of(length, count), "g long, n long, missed long")
    sums = written(sent.groupBy("g").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed")), "seeds")
    every = sums.filter("g IS NULL").first()
    if every is None:
        return np.zeros(0, dtype=np.uint64)
    line = max(hot_rows, every.n // share, 2 * every.missed) - every.missed
    found = sums.filter(F.col("g").isNotNull() & (F.col("n") > line)).select("g").toArrow()  # 2 * share rows at most
    return np.sort(found["g"].to_numpy().view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _anchors(docs: DataFrame, length: int, seed: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, copy, at, g, c, state): the winnowed positions; done ones have a g that spreads them, hot ones one of seed and context."""
    kind = docs.schema["doc_id"].dataType
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def anchors(rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        some = Winnowed(rows, length, seed)
        is_hot = _among(some.g, known.value) & ~some.done
        with np.errstate(over="ignore"):
            spread = _mixed(some.at.astype(np.uint64) + some.owner.astype(np.uint64) * np.uint64(_STEP))
            g = np.where(some.done, spread, np.where(is_hot, _mixed(some.g + some.c * np.uint64(_STEP)), some.g))
        state = np.where(some.done, DONE, np.where(is_hot, HOT, OPEN)).astype(np.int8)
        owner = pa.array(some.owner)
        columns = [pa.array([r[0] for r in rows], id_type).take(owner), pa.array([r[1] for r in rows], pa.int64()).take(owner)]
        columns += [pa.array(some.at), pa.array(g.view(np.int64)), pa.array(some.c.view(np.int64)), pa.array(state)]
        yield from _sliced(pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "at", "g", "c", "state"]))

    schema = StructType.fromDDL("copy long, at long, g long, c long, state byte")
    return docs.select("doc_id", "copy", "text").mapInArrow(_texts_of(length, anchors), StructType([StructField("doc_id", kind), *schema.fields]))


def _sliced(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _judged(anchors: DataFrame, hot_contexts: int) -> DataFrame:
    """(doc_id, copy, at, g, kind): repeated with the whole context, or the first place of one of several contexts of a seed."""
    line = Window.partitionBy("g").orderBy("c", "doc_id", "at", "copy")
    seed = Window.partitionBy("g")
    here = F.struct("doc_id", "at", "copy")
    marked = (
        anchors.withColumn("opens", F.coalesce(F.lag("c").over(line) != F.col("c"), F.lit(True)))
        .withColumn("first", F.last(F.when(F.col("opens"), here), ignorenulls=True).over(line))
        .withColumn("contexts", F.sum(F.col("opens").cast("int")).over(seed))
    )
    repeated = (F.col("state") == DONE) | (F.col("first") != here)
    hot = (F.col("state") == HOT) | (F.col("contexts") > hot_contexts)
    kind = F.when(repeated, REPEATED).when(F.col("opens") & hot, HOT_EDGE).when(F.col("opens") & (F.col("contexts") > 1), EDGE)
    return marked.select("doc_id", "copy", "at", "g", kind.cast("byte").alias("kind")).filter("kind IS NOT NULL")


def _contexts(docs: DataFrame, edges: DataFrame, length: int, seed: int) -> DataFrame:
    """(g, doc_id, copy, at, kind, ctx): the bytes around each edge; of hot ones, a row a position with two names of its string as g and ctx, or known to repeat."""
    kind = docs.schema["doc_id"].dataType
    listed = edges.groupBy("doc_id", "copy").agg(F.collect_list(F.struct(F.col("at").alias("p"), "g", "kind")).alias("edges"))
    same = docs["doc_id"].eqNullSafe(listed["doc_id"]) & docs["copy"].eqNullSafe(listed["copy"])
    # All columns, so that this and the last join read one shuffle of the texts.
    joined = docs.join(listed, same).select(*[docs[c] for c in docs.columns], "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, copies = batch.column("doc_id"), batch.column("copy").to_numpy()
            own, starts, seeds, kinds, bytes_ = [], [], [], [], []
            hot: list[tuple[np.ndarray, ...]] = []
            lists = batch.column("edges")
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            p_all, g_all, k_all = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text.encode()
                mine = slice(offsets[i], offsets[i + 1])
                p, g, k = p_all[mine], g_all[mine], k_all[mine]
                for at, s in zip(p[k == EDGE].tolist(), g[k == EDGE].tolist()):
                    lo = max(0, at + seed - length)
                    own.append(i)
                    starts.append(lo)
                    seeds.append(s)
                    kinds.append(EDGE)
                    bytes_.append(text[lo : at + length])
                if (k == HOT_EDGE).any():
                    raw = np.frombuffer(text, dtype=np.uint8)
                    s = np.unique(np.concatenate([np.arange(max(0, a + seed - length), min(a, len(raw) - length) + 1) for a in p[k == HOT_EDGE].tolist()]))
                    hot.append((np.full(len(s), i), s, *[_names(_prefix_sums(raw, values), s, s + length) for values in (_BYTE, _BYTE_2)]))
            if hot:
                rows, place, name, second, known = _settled(ids.to_pylist(), copies, *map(np.concatenate, zip(*hot)))
                own += rows.tolist()
                starts += place.tolist()
                seeds += name.view(np.int64).tolist()
                kinds += np.where(known, REPEATED, HOT_EDGE).tolist()
                bytes_ += [None if x else n.tobytes() for x, n in zip(known.tolist(), second)]
            owner = pa.array(own, pa.int64())
            columns = [pa.array(seeds, pa.int64()), ids.take(owner), batch.column("copy").take(owner), pa.array(starts, pa.int64()), pa.array(kinds, pa.int8()), pa.array(bytes_, pa.binary())]
            yield from _sliced(pa.RecordBatch.from_arrays(columns, names=["g", "doc_id", "copy", "at", "kind", "ctx"]), 10_000)

    fields = StructType.fromDDL("copy long, at long, kind byte, ctx binary").fields
    return joined.mapInArrow(run, StructType([*StructType.fromDDL("g long").fields, StructField("doc_id", kind), *fields]))


def _settled(ids: list, copies: np.ndarray, row: np.ndarray, place: np.ndarray, name: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, name, second name, known): all but the earliest of a string are known to repeat, and get a name that spreads them."""
    number = {x: n for n, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x)))}
    rank, copy = np.array([number[x] for x in ids], dtype=np.int64)[row], copies[row]
    order = np.lexsort((copy, place, rank, second, name))
    row, place, name, second, rank, copy = (x[order] for x in (row, place, name, second, rank, copy))
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (second[1:] != second[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    known = (rank != rank[first]) | (place != place[first]) | (copy != copy[first])
    with np.errstate(over="ignore"):
        name = np.where(known, _mixed(name + place.astype(np.uint64) * np.uint64(_STEP) + rank.astype(np.uint64)), name)
    return row, place, name, second, known


def _doubled(g: np.ndarray, ctx: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, rank at full length) of positions in contexts whose string is not unique for its seed."""
    half = length // 2
    sizes = np.array([len(x) for x in ctx], dtype=np.int64)
    sums = _prefix_sums(np.frombuffer(b"".join(ctx), dtype=np.uint8))
    base = np.cumsum(sizes) - sizes
    # Rank at half length: every position with half the length to come.
    n = sizes - half + 1
    row = np.repeat(np.arange(len(ctx)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base[row] + pos
    with np.errstate(over="ignore"):
        name = _names(sums, start, start + half) + _mixed(g.view(np.uint64))[row]
    _, rank, count = np.unique(name, return_inverse=True, return_counts=True)
    # Pairs at the offset, both halves not unique.
    ends = np.flatnonzero(pos + length <= sizes[row])
    rest = length - half
    first, second = rank[ends], rank[ends + rest]
    ends = ends[(count[first] > 1) & (count[second] > 1)]
    pair = rank[ends].astype(np.int64) * (len(count) + 1) + rank[ends + rest]
    _, full, count = np.unique(pair, return_inverse=True, return_counts=True)
    keep = count[full] > 1
    return row[ends[keep]], pos[ends[keep]], full[keep]


def _firsts(*names: np.ndarray) -> np.ndarray:
    """For each row the first row that has the same names; rows come in order of place."""
    order = np.lexsort(names[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for n in names:
        new[1:] |= n[order][1:] != n[order][:-1]
    first = np.empty_like(order)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return first


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, copy, first, last): byte ranges of repeated strings found at edges."""
    kind = contexts.schema["doc_id"].dataType
    dealt = contexts.repartition("g").sortWithinPartitions("g", "doc_id", "at", "copy")

    def judge(table: pa.Table) -> pa.RecordBatch:
        g, at, copy, state = (table.column(c).to_numpy() for c in ("g", "at", "copy", "kind"))
        ids = table.column("doc_id").combine_chunks()
        ctx = table.column("ctx").to_pylist()
        code = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        code = np.nan_to_num(code, nan=-1).astype(np.int64)
        known = np.flatnonzero(state == REPEATED)
        rows, starts = [known], [np.zeros(len(known), dtype=np.int64)]
        one = np.flatnonzero(state == HOT_EDGE)
        if len(one):
            first = one[_firsts(g[one], _second(ctx, one))]
            again = (code[one] != code[first]) | (at[one] != at[first]) | (copy[one] != copy[first])
            rows.append(one[again])
            starts.append(np.zeros(again.sum(), dtype=np.int64))
        full = np.flatnonzero(state == EDGE)
        if len(full):
            row, pos, rank = _doubled(g[full], [ctx[i] for i in full], length)
            row = full[row]
            # Rows of a seed come by doc_id and place, but contexts of texts under one id mix their positions.
            place = at[row] + pos
            order = np.lexsort((copy[row], place, np.maximum.accumulate(_opens(code))[row], rank))
            row, pos, place, rank = row[order], pos[order], place[order], rank[order]
            # Overlapping contexts of one text list a position twice; both have the same place.
            least = _firsts(rank)
            again = (code[row] != code[row[least]]) | (place != place[least]) | (copy[row] != copy[row[least]])
            rows.append(row[again])
            starts.append(pos[again])
        row = np.concatenate(rows)
        first = at[row] + np.concatenate(starts)
        order = np.lexsort((first, row))
        row, first = row[order], first[order]
        runs = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] > first[:-1] + length)))) if len(row) else row
        last = np.concatenate((runs[1:], [len(row)])).astype(np.int64) - 1 if len(row) else row
        own = row[runs]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(own, pa.int64())), pa.array(copy[own]), pa.array(first[runs]), pa.array(first[last] + length)],
            names=["doc_id", "copy", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= CONTEXTS_AT_ONCE:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                whole = int(np.searchsorted(g, g[-1]))  # the last seed may go on
                hot = table.column("kind").to_numpy() == HOT_EDGE
                if whole == 0 and hot.all():
                    # One name of hot strings: everything after a string's first place repeats, so only that is kept.
                    yield judge(table)
                    firsts = np.unique(_firsts(_second(table.column("ctx").to_pylist(), np.arange(len(hot)))))
                    held, count = table.take(pa.array(firsts)).combine_chunks().to_batches(), len(firsts)
                    continue
                if whole:
                    yield judge(table.slice(0, whole))
                    held, count = table.slice(whole).to_batches(), table.num_rows - whole
        if held:
            yield judge(pa.Table.from_batches(held))

    fields = StructType.fromDDL("copy long, first long, last long").fields
    return dealt.mapInArrow(run, StructType([StructField("doc_id", kind), *fields]))


def _second(ctx: list[bytes], rows: np.ndarray) -> np.ndarray:
    """The second names of hot rows."""
    return np.frombuffer(b"".join([ctx[i] for i in rows.tolist()]), dtype=np.uint64)


def _opens(code: np.ndarray) -> np.ndarray:
    """The number of each row where a new code begins, else 0."""
    return np.where(np.concatenate(([True], code[1:] != code[:-1])), np.arange(len(code)), 0)


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    seed: int = SEED,
    hot_contexts: int = HOT_CONTEXTS,
    keep: tuple[str, ...] = (),
    prefix: str = "",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row a document: n_bytes, n_removed, n_spans, kept_sha256, clean_text, each with ``prefix``, and the columns in ``keep``."""
    if not 0 < seed < length or length < 4:
        raise ValueError("seed must be shorter than length")
    ship(docs.sparkSession)
    text = named(text_col)
    own = docs.select(named(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("copy"), *carried(docs, keep))
    anchors = _anchors(own, length, seed, hot_seeds(own, length, seed, hot_rows))
    judged = written(_judged(anchors, hot_contexts), "judged")
    found = _repeats(_contexts(own, judged.filter(F.col("kind") != REPEATED), length, seed), length)
    around = judged.filter(F.col("kind") == REPEATED).select("doc_id", "copy", (F.col("at") + (seed - length)).alias("first"), (F.col("at") + length).alias("last"))
    spans = around.union(found).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    same = own["doc_id"].eqNullSafe(spans["doc_id"]) & own["copy"].eqNullSafe(spans["copy"])
    joined = own.join(spans, same, "left").select(own["doc_id"], "text", *[f"_k{i}" for i in range(len(keep))], "spans")
    schema = schema_of(own, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, clean_text string", keep, prefix)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = [cut_spans(text, spans) for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *[batch.column(f"_k{i}") for i in range(len(keep))]], names=names)

    return joined.mapInArrow(run, schema)


def cut_spans(text: str | None, spans: list[dict] | None) -> tuple[int, int, int, str, str | None]:
    """(bytes, removed bytes, maximal removed runs, digest of the rest, the rest as text)."""
    raw = (text or "").encode()
    if not spans:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text
    kept, at, runs, removed, end = [], 0, 0, 0, -1
    for first, last in sorted((max(0, s["first"]), min(len(raw), s["last"])) for s in spans):
        if first > end:
            kept.append(raw[at:first])
            runs += 1
            removed += last - first
            at = end = last
        elif last > end:
            removed += last - end
            at = end = last
    kept.append(raw[at:])
    rest = b"".join(kept)
    return len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")
