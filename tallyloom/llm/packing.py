"""Best-fit packing of token sequences with matching of large items.

Documents are tokenised and ended by one id; only documents longer than a
sequence are cut, into full pieces and a remainder.  What has to be decided
depends on the lengths alone, and there are at most ``capacity`` of those:
one count by length is the whole input of the plan, whatever the table's
size.  The plan

1. gives pieces of full length a sequence of their own,
2. matches large pieces (above a third of the capacity, so that at most two
   share a sequence), longest first, each with the longest partner that fits,
3. puts small pieces, longest first, into the tightest gap that holds them,
   and opens a new sequence only where no gap does.

Each step moves as many equal pieces into as many equal gaps as there are,
so the plan has some thousands of steps.  Documents find their place by
their rank among pieces of the same length, which salted windows and a table
of offsets give.  A length has as many salts as its count asks for, so no
group has many more than ``RANKED`` pieces, or a ``MOST_GROUPS``th of all.

Defined results: null and empty texts are one id long; rows that repeat a
doc_id are packed each on their own; texts of any length are encoded whole
and cut into pieces; other columns are dropped; an empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, ship, small_batches, written
from tallyloom.llm.tokens import encoder as open_encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked together, and how many such groups the driver holds beside one a length.
RANKED = 500
MOST_GROUPS = 200_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document."""
    ship(docs.sparkSession)
    own = id_and_text(docs, id_col, text_col)
    kind = dict(own.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = open_encoder(tokenizer)
        width = capacity * 4
        for batch in small_batches(batches, 500):
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, ids in enumerate(encoder.encode_batch(batch.column("text").to_pylist())):
                ids += end
                for no, i in enumerate(range(0, len(ids), width)):
                    part = ids[i : i + width]
                    owner.append(row)
                    piece.append(no)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(run, schema)


class Plan:
    """Steps (length, first rank, count, first sequence, offset) from the counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self._used: dict[int, int] = defaultdict(int)
        self._gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: [(first sequence, count)]
        self._sizes: list[int] = []  # gaps there are, ascending
        self._capacity = capacity
        left = {n: c for n, c in counts.items() if c}
        large = sorted(n for n in left if 3 * n > capacity)
        self._match(left, large)
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fit(n, left[n])

    def _place(self, n: int, count: int, first: int, offset: int) -> None:
        self.steps.append((n, self._used[n], count, first, offset))
        self._used[n] += count

    def _open(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def _leave(self, gap: int, first: int, count: int) -> None:
        if not gap:
            return
        if not self._gaps[gap]:
            bisect.insort(self._sizes, gap)
        self._gaps[gap].append((first, count))

    def _match(self, left: dict[int, int], large: list[int]) -> None:
        """Longest first, with the longest partner that fits; a length with itself in pairs."""
        while large:
            a = large[-1]
            at = bisect.bisect_right(large, self._capacity - a) - 1
            if at >= 0 and large[at] == a and left[a] == 1:
                at -= 1  # the last one of a length looks for a shorter partner
            if at < 0:
                large.pop()
                first = self._open(left[a])
                self._place(a, left[a], first, 0)
                self._leave(self._capacity - a, first, left[a])
                continue
            b = large[at]
            if a == b:
                pairs = left[a] // 2
            else:
                pairs = min(left[a], left[b])
            first = self._open(pairs)
            self._place(a, pairs, first, 0)
            self._place(b, pairs, first, a)
            self._leave(self._capacity - a - b, first, pairs)
            for n in (a, b):
                left[n] -= pairs
            for n in {a, b}:
                if not left[n]:
                    large.remove(n)

    def _fit(self, n: int, count: int) -> None:
        """Each into the tightest gap; new sequences where none is wide enough."""
        while count:
            at = bisect.bisect_left(self._sizes, n)
            if at == len(self._sizes):
                # Filled up in turn with more of the same, as best fit would.
                each = self._capacity // n
                rows = max(1, count // each)
                self._leave(self._capacity, self._open(rows), rows)
                continue
            gap = self._sizes[at]
            first, there = self._gaps[gap].pop()
            take = min(count, there)
            if take < there:
                self._gaps[gap].append((first + take, there - take))
            elif not self._gaps[gap]:
                self._sizes.pop(at)
            self._place(n, take, first, self._capacity - gap)
            self._leave(gap - n, first, take)
            count -= take


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity.

    rows must be stable when read again (a written table), as ranks are
    counted once and used in a second pass.
    """
    spark = rows.sparkSession
    ship(spark)
    counts = {r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}  # capacity rows at most
    for n in counts:
        if n is None or not 1 <= n <= capacity:
            raise ValueError(f"a piece is {n} long; the capacity is {capacity}")
    share = max(RANKED, -(-sum(counts.values()) // MOST_GROUPS))
    salts = np.ones(capacity + 1, dtype=np.int64)
    for n, count in counts.items():
        salts[n] = -(-count // share)
    # Groups of all lengths stand in one row; length n has those from start[n] on.
    start = np.concatenate(([0], np.cumsum(salts)))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in rows.columns] or [length_col]
    grouped = F.broadcast(spark.createDataFrame([(int(n), int(salts[n]), int(start[n])) for n in counts], "_n int, _salts int, _start int"))
    salted = (
        rows.join(grouped, F.col(length_col) == F.col("_n"))
        .withColumn("_group", (F.col("_start") + F.pmod(F.xxhash64(*order), F.col("_salts"))).cast("int"))
        .drop("_n", "_salts", "_start")
    )
    held = salted.groupBy("_group").agg(F.count("*").alias("n")).toArrow()  # MOST_GROUPS + capacity rows at most
    sizes = np.zeros(start[-1], dtype=np.int64)
    sizes[held["_group"].to_numpy()] = held["n"].to_numpy()
    offsets = np.cumsum(sizes) - sizes
    offsets -= np.repeat(offsets[start[:-1]], salts)
    plan = Plan(dict(counts), capacity)
    steps = np.array(sorted(plan.steps) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    table = spark.sparkContext.broadcast((offsets, (steps[:, 0] << 44) + steps[:, 1], steps))

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy(*order)) - 1)
    names = rows.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, keys, steps = table.value
        for batch in batches:
            n = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64) + offsets[batch.column("_group").to_numpy(zero_copy_only=False)]
            at = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
            sequence = steps[at, 3] + rank - steps[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(steps[at, 4])],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their sequence_id and offset; with_ids carries the ids themselves."""
    return pack(written(pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length) of packed pieces that carry ids; a sequence has ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", ids.alias("ids")).withColumn("length", (F.octet_length("ids") / 4).cast("long"))
