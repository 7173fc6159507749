"""SimHash near-duplicate groups by pigeonhole blocks.

Fingerprint: XXH64 (seed 42) of every word shingle, a bit set where more
than half of the hashes have it.  Documents with one fingerprint collapse to
one row before anything is compared.

Pairs: the 64 bits are cut into ``blocks`` pieces; two fingerprints that
differ in at most ``distance`` bits agree on at least blocks - distance
pieces, so each fingerprint is keyed by every choice of that many pieces and
pairs are sought within equal keys, then verified by Hamming distance.

Large keys: a key shared by more than ``bucket_limit`` distinct fingerprints
emits no pairs.  Its fingerprints are linked exactly through centres instead:
two words at distance 2 or less are both within one bit of a common word, so
each member lists itself and its one-bit neighbours, and members that list
the same word are linked to the least of them.  A centre has at most 65
members, so the work is linear in the size of the key.

Defined results: null and wordless texts have fingerprint zero and are
linked like any other; rows that repeat a doc_id give a row each with the
fingerprint of their own text; a row without an id takes the least id of its
group, and a group without any id has none; texts of any length are taken
whole; other columns are dropped; an empty table gives an empty result.

Scale: text is read once and not shuffled; 33 numbers a document are.  Spark
sizes what an explode makes as if it were one row a row, so joins with keys or
pairs ask for a merge: left to its sizes it would broadcast them by the driver.

``similar_groups`` is the same method set wider, for texts that differ in a
few words in a hundred.  Copies collapse to one text.  The fingerprint is over
the different words of a text, as an edit changes one of those where it
changes five shingles; keys are exact for ``WIDE`` bits, with as many blocks
as the number of fingerprints asks for (28 keys a fingerprint up to some 300
million of them, 84 up to 10 billion).  What is linked so is a candidate
only: within each closure of such links, texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more are linked, and the
components of these links are the groups.  Keys over ``bucket_limit`` and
closures of any size are compared in blocks of bounded size, and a pair of
blocks gives no more links than join its members; so no link is lost and no
pairs are emitted.  A closure of more than one block is cut into bands by the
size of a text's set first, and a band is compared with itself and the next
only, as sets further apart cannot be that similar.  Work on a key or a band
grows with the square of its different fingerprints or texts, spread over
tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import BLANK_GAP, LOWER, UPPER, ascii_lower, id_and_text, ship, small_batches, split_words, written
from tallyloom.llm.components import connected_components

SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
BUCKET_LIMIT = 24
#: Of similar_groups: bits by which candidates may differ, words in a shingle, least Jaccard similarity.
WIDE = 6
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints, or bytes of shingles, in a block.
BLOCK_FINGERPRINTS = 2048
BLOCK_BYTES = 1 << 20
#: Words of 64 bits in the bitmap of candidates, which is broadcast.
BITMAP_WORDS = 1 << 18


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """(doc_id, fp) for each input row; distinct takes each word of a text once.

    Rows are grouped by doc_id and a hash of the text; a repeated row adds
    its hashes again, which changes no majority, and is given back again.

    Bits are counted two at a time: hash >> j masked to bits 0 and 32 adds
    the counts of bits j and j + 32 in one long, exact below 2**32 shingles.
    """
    words_ = split_words(ascii_lower(F.col("text")), BLANK_GAP)
    words = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"),
        (F.array_distinct(words_) if distinct else words_).alias("words"),
    )
    rolled = words.select("doc_id", "copy", "words", F.posexplode_outer("words").alias("pos", "word")).withColumn(
        "pos", F.coalesce("pos", F.lit(0))
    )
    n = F.size("words")
    whole = (F.col("pos") == 0) & (n < shingle) & (n > 0)
    follow = [F.get("words", F.col("pos") + i) for i in range(shingle)]
    text = F.when(F.col("pos") + (shingle - 1) < n, F.concat_ws(" ", *follow)).when(whole, F.array_join("words", " "))
    hashes = rolled.select("doc_id", "copy", "pos", text.alias("text")).select(
        "doc_id", "copy", "pos", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h")
    )
    # Words past the last shingle have no hash; word 0 counts the input rows of the group.
    pair = 0x0000000100000001
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(pair))).alias(f"s{j}") for j in range(32)]
    rows = F.count_if(F.col("pos") == 0).cast("int").alias("rows")
    counted = hashes.groupBy("doc_id", "copy").agg(F.count("h").alias("n"), rows, *sums)
    bits = F.lit(0).cast("long")
    for j in range(32):
        low = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"s{j}"), 32)
        for count, bit in ((low, j), (high, j + 32)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    fp = F.coalesce(bits, F.lit(0).cast("long")).alias("fp")
    return counted.select("doc_id", fp, F.explode(F.array_repeat(F.lit(1), F.col("rows")))).select("doc_id", "fp")


def _pieces(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(fp: Column, blocks: int, distance: int) -> Column:
    """An array of (choice, kept bits) for every choice of blocks - distance pieces."""
    pieces = _pieces(blocks)
    out = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (pieces[i][1] - pieces[i][0])) - 1) << pieces[i][0] for i in chosen)
        out.append(F.struct(F.lit(no).alias("choice"), fp.bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("kept")))
    return F.array(*out)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) of distinct fingerprints whose closure equals that of all pairs within ``distance``.

    fps: distinct values in column ``fp``.
    """
    if not 0 < distance < blocks:
        raise ValueError("blocks must exceed distance, and distance be 1 or more")
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), blocks, distance)).alias("key")).select("fp", "key.*")
    counts = keyed.groupBy("choice", "kept").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.hint("merge").join(counts, ["choice", "kept"])
    small = met.filter(F.col("n") <= bucket_limit)
    left = small.select("choice", "kept", F.col("fp").alias("a"))
    right = small.select("choice", "kept", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.hint("merge").join(right, ["choice", "kept"]).filter((F.col("a") < F.col("b")) & close).select("a", "b")
    large = met.filter(F.col("n") > bucket_limit)
    if distance > 2:
        return pairs.union(_links_by_block(large, distance))
    return pairs.union(_links_by_centre(large.select("fp").distinct(), distance))


def _links_by_centre(fps: DataFrame, distance: int) -> DataFrame:
    """Exact links without pairs: members of a common centre within ``distance`` // 2 flips, or an odd bit more on one side."""
    flips = [0] + [_signed(1 << i) for i in range(64)]
    if distance == 1:
        near, far = [0], flips
    else:
        near, far = flips, flips
    if near == far:
        listed = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in flips])).alias("centre"))
        members = listed.groupBy("centre").agg(F.sort_array(F.collect_list("fp")).alias("m")).filter(F.size("m") > 1)
        return members.select(F.element_at("m", 1).alias("a"), F.explode(F.slice("m", 2, 64)).alias("b"))
    listed = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in far])).alias("a"))
    return listed.hint("merge").join(fps.select(F.col("fp").alias("a")), "a").filter("a < b").select("a", "b")


def _pairs_of_blocks(blocks: DataFrame, key: list[str], inside: str) -> DataFrame:
    """Each pair of different blocks of one key, dealt out by pair: (a, b), the ``inside`` columns of both.

    blocks: key, block (from 0), blocks (how many the key has), inside.
    """
    many = blocks.filter("blocks > 1")
    pairs = many.select(*key, F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks"))).alias("j")).filter("j < blocks")
    one, two = (many.select(*key, F.col("block").alias(n), F.col(inside).alias(m)) for n, m in (("i", "a"), ("j", "b")))
    return pairs.hint("merge").join(one, [*key, "i"]).hint("merge").join(two, [*key, "j"]).select("a", "b")


def _links_by_block(large: DataFrame, distance: int) -> DataFrame:
    """Links of the fingerprints of each large key (choice, kept, n): blocks are compared whole, and only links that join something are given."""
    ship(large.sparkSession)
    count = F.ceil(F.col("n") / BLOCK_FINGERPRINTS).cast("int")
    placed = large.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("choice", "kept", "blocks", "block").agg(F.collect_list("fp").alias("fps"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 20):
            left = batch.column(0).to_pylist()
            right = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * len(left)
            links = []
            for a, b in zip(left, right):
                a = np.array(a, dtype=np.int64)
                b = a if b is None else np.array(b, dtype=np.int64)
                forest = Forest()
                for x in a.tolist():
                    near = b[np.bitwise_count((b ^ x).view(np.uint64)) <= distance]
                    links += [(x, y) for y in near.tolist() if forest.joins(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    across = _pairs_of_blocks(blocks, ["choice", "kept"], "fps")
    return blocks.select("fps").mapInArrow(compare, "a long, b long").union(across.mapInArrow(compare, "a long, b long"))


class Forest:
    """Union-find over whatever is joined."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x: object) -> object:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joins(self, x: object, y: object) -> bool:
        """Join x and y; whether they were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[x] = y
        return True


def blocks_for(count: int, distance: int) -> int:
    """The least number of blocks for which a key holds some thousand fingerprints or fewer, which are compared at once; more blocks mean many more keys."""
    wanted = math.log2(max(count, 2)) - 12
    return next((b for b in range(distance + 2, 2 * distance) if 64 * (b - distance) / b >= wanted), 2 * distance)


_LOWERED = str.maketrans(UPPER, LOWER)


def shingle_set(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """Ascending hashes of the different ``size``-word shingles of a text; of all its words if they are fewer, none if it has none."""
    words = (text or "").translate(_LOWERED).encode().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    names = np.array([xxhash.xxh64_intdigest(w) for w in number], dtype=np.uint64)[ids]
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ names[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def similar_pairs(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Places (in a, in b) of sets with at least that Jaccard similarity; two empty sets are equal."""
    sizes = np.array([len(x) for x in b], dtype=np.int64)
    owner = np.repeat(np.arange(len(b)), sizes)
    every = np.concatenate([*b, np.zeros(0, dtype=np.uint64)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for i, x in enumerate(a):
        first, last = np.searchsorted(every, x, side="left"), np.searchsorted(every, x, side="right")
        count = last - first
        at = np.repeat(last - np.cumsum(count), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(b))
        either = sizes + len(x) - common
        for j in np.flatnonzero(common >= similarity * either).tolist():
            yield i, j


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = WIDE, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(text_hash, doc_id, component) for each different text: its least doc_id, nulls last, and the least text_hash of its group.

    text_hash is xxhash64 of the text; null counts as empty, and texts
    without a word are one group.
    """
    spark = docs.sparkSession
    ship(spark)
    own = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    rows = written(fingerprints(own, "node", "text", 1, distinct=True).withColumnRenamed("doc_id", "node").distinct(), "word-fingerprints")
    fps = written(rows.select("fp").distinct(), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(fps, distance, blocks_for(fps.count(), distance), bucket_limit))
    # Texts with one fingerprint are candidates too.
    rooted = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("closure"))
    crowded = rooted.groupBy("closure").agg(F.count("*").alias("texts")).filter("texts > 1").select("closure")
    members = written(rooted.join(crowded, "closure"), "members")
    # One row a text before the shuffle, so that copies do not meet in one task.
    once = _sifted(own, members).groupBy("node").agg(F.first("text").alias("text"))
    chosen = once.hint("merge").join(members, "node").select("closure", "node", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("closure"), batch.column("node"), pa.array(sets, pa.binary())], names=["closure", "node", "shingles"])

    sets = written(chosen.mapInArrow(shingles, "closure long, node long, shingles binary"), "shingles")
    layout = _layout(sets, similarity)
    placed = sets.withColumn("size", _size_class(similarity)).join(layout, ["closure", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("closure", "band", "block").agg(F.collect_list(F.struct("node", "shingles")).alias("texts"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 20):
            links = []
            for row in range(batch.num_rows):
                sides = [_unpacked(batch.column(k)[row]) for k in range(batch.num_columns)]
                (names, a), (others, b) = sides[0], sides[-1]
                forest = Forest()
                links += [(names[i], others[j]) for i, j in similar_pairs(a, b, similarity) if forest.joins(names[i], others[j])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    one, two = (blocks.select("closure", F.col("band").alias(n), F.col("block").alias(i), F.col("texts").alias(m)) for n, i, m in (("p", "i", "a"), ("q", "j", "b")))
    across = _block_pairs(layout).hint("merge").join(one, ["closure", "p", "i"]).hint("merge").join(two, ["closure", "q", "j"]).select("a", "b")
    links = blocks.select("texts").mapInArrow(verify, "a long, b long").union(across.mapInArrow(verify, "a long, b long"))
    groups = connected_components(links)
    least = own.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    return least.join(groups, "node", "left").select(F.col("node").alias("text_hash"), F.col("least.doc_id").alias("doc_id"), F.coalesce("root", "node").alias("component"))


def _size_class(similarity: float) -> Column:
    """The logarithm of a set's size in steps of a little over 1 / similarity: sets that similar are of one class or of neighbouring ones.  Empty sets are of class 0."""
    n = F.octet_length("shingles") / 8
    return F.when(n > 0, F.floor(F.log(n) / math.log(1.01 / similarity)).cast("int") + 1).otherwise(0)


def _layout(sets: DataFrame, similarity: float) -> DataFrame:
    """(closure, size, band, blocks): the size classes of a closure of more than one block are its bands, each cut into blocks; any other closure is one block in band -1."""
    sizes = sets.groupBy("closure", _size_class(similarity).alias("size")).agg(F.sum(F.octet_length("shingles") + 16).alias("bytes"))
    large = F.sum("bytes").over(Window.partitionBy("closure")) > BLOCK_BYTES
    blocks = F.when(F.col("large"), F.ceil(F.col("bytes") / BLOCK_BYTES)).otherwise(1).cast("int").alias("blocks")
    return sizes.withColumn("large", large).select("closure", "size", F.when(F.col("large"), F.col("size")).otherwise(-1).alias("band"), blocks)


def _block_pairs(layout: DataFrame) -> DataFrame:
    """(closure, p, i, q, j): block i of band p is to be compared with block j of band q, which is p or the next; each pair of different blocks once."""
    bands = layout.filter("band >= 0").select("closure", F.col("band").alias("p"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    within = bands.select("closure", "p", "i", F.col("p").alias("q"), "blocks", F.explode(F.sequence(F.col("i") + 1, F.col("blocks"))).alias("j")).filter("j < blocks").drop("blocks")
    following = layout.filter("band >= 0").select("closure", (F.col("band") - 1).alias("p"), F.col("blocks").alias("others"))
    between = bands.join(following, ["closure", "p"]).select("closure", "p", "i", (F.col("p") + 1).alias("q"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"))
    return within.unionByName(between)


def _sifted(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows without most of those whose node is no member, by a bitmap of ``BITMAP_WORDS`` words at most, so that their texts are not shuffled."""
    word = lambda: F.pmod(F.shiftright("node", 6), F.lit(BITMAP_WORDS))
    bit = F.expr("shiftleft(1L, CAST(node & 63 AS int))")
    bitmap = members.groupBy(word().alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.withColumn("word", word()).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _unpacked(texts: pa.ListScalar) -> tuple[list[int], list[np.ndarray]]:
    rows = texts.as_py()
    return [r["node"] for r in rows], [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each input row; component_id is the least doc_id reachable by links."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(classes.select("fp"), distance, blocks, bucket_limit)
    roots = connected_components(links)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
