"""Language of each text by a linear-chain conditional random field over its words.

Features of a word: its character 2- and 3-grams with word ends marked, the
4-grams at its ends (so prefixes and suffixes up to three letters), and for
each language whether the learned lexicon lists the word for it.  Grams are
hashed into ``BUCKETS`` weights a language.  Transitions between languages
and the first word's language are learned with them: training sequences join
pieces of documents in different languages, so that switches within a text
are learned too.  Every word of the training texts stands in a piece; short
texts and the ends of longer ones give short pieces.

Forward-backward gives every word its language probabilities in the whole
text's context; their mean over the words is the text's, and the largest of
them its score.

Training takes ``train_limit`` labelled rows of those whose crc32(id as text)
mod 4 is not 2: the first by hash of each language, then the first by hash of
all.  Their texts are whole unless they exceed ``train_chars`` characters in
sum; then the longest are cut to one common length, so that every chosen row
and its language stay.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any labelled row that has a word all texts are; rows that repeat a doc_id are
labelled each on their own text; texts of any length are labelled whole;
other columns are dropped; an empty table gives an empty result.

Scale: three scans for the sample, which shuffle keys only, and one for the
labels; the model has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ship, small_batches

TRAIN_LIMIT = 600
BUCKETS = 1 << 16
LEXICON = 500
PIECE = 16
ROUNDS = 30
#: Characters of all training texts together, to bound the driver's memory.
TRAIN_CHARS = 4_000_000
#: Rows labelled at once, fewer of long texts.
ROWS = 2_500
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text; none if it has no letter, as superscripts and fractions alone are not one."""
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, position, starts): the hashed grams of all words; positions from starts[k] on belong to word k."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n\n\n\n").encode("utf-32-le"), dtype=np.uint32)
    edge = codes == 10
    size = len(codes) - 4
    starts = np.flatnonzero(edge[:size])
    buckets_, places = [], []
    at = np.arange(size)
    h = codes[:size].astype(np.uint32) * np.uint32(0x9E3779B1)
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            h = (h ^ codes[n - 1 : n - 1 + size]) * np.uint32(0x85EBCA77)
            h ^= h >> np.uint32(13)
            inner = np.zeros(size, dtype=bool)
            for i in range(1, n - 1):
                inner |= edge[i : i + size]
            good = ~inner & ~(edge[:size] & edge[n - 1 : n - 1 + size] & (n == 2))
            if n == 4:
                good &= edge[:size] | edge[3 : 3 + size]
            mixed = h[good] * np.uint32(0xC2B2AE3D)
            buckets_.append(((mixed >> np.uint32(8)) % np.uint32(buckets)).astype(np.int32))
            places.append(at[good])
    bucket, place = np.concatenate(buckets_), np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return bucket[order], place[order], starts[: len(words)]


class Model:
    """Weights of a chain over ``labels``."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.gram = np.zeros((BUCKETS, n), dtype=np.float32)
        self.listed = np.zeros((n + 1, n), dtype=np.float32)
        self.move = np.zeros((n, n))
        self.first = np.zeros(n)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word by itself."""
        if not words:
            return np.zeros((0, len(self.labels)), dtype=np.float32)
        bucket, place, starts = grams(words)
        begin = np.searchsorted(place, starts)
        return np.add.reduceat(self.gram[bucket], begin, axis=0) + self.listed[[self.lexicon.get(w, 0) for w in words]]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; sequences stand one after another in ``scores`` and all run in step, longest first."""
    n = scores.shape[1]
    if not len(scores):
        return scores.astype(np.float64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    most = int(size[0])
    active = np.searchsorted(-size, -np.arange(most), side="left")  # sequences longer than t
    push = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    step = np.exp(move - move.max())
    ahead = np.empty_like(push)
    here = np.exp(first - first.max()) * push[start[: active[0]]]
    here /= here.sum(axis=1, keepdims=True)
    ahead[start[: active[0]]] = here
    for t in range(1, most):
        k = active[t]
        at = start[:k] + t
        here = (here[:k] @ step) * push[at]
        here /= here.sum(axis=1, keepdims=True)
        ahead[at] = here
    back = np.ones((len(size), n))
    for t in range(most - 1, 0, -1):
        k = active[t]
        at = start[:k] + t
        back[:k] = (back[:k] * push[at]) @ step.T
        back[:k] /= back[:k].sum(axis=1, keepdims=True)
        ahead[at - 1] *= back[:k]
    return ahead / ahead.sum(axis=1, keepdims=True)


def expectations(scores: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities, expected moves) of sequences of one length, scores by (sequence, word, label)."""
    size, most, n = scores.shape
    push = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    step = np.exp(move - move.max())
    ahead = np.empty((most, size, n))
    here = np.exp(first - first.max()) * push[:, 0]
    for t in range(most):
        if t:
            here = (here @ step) * push[:, t]
        here /= here.sum(axis=1, keepdims=True)
        ahead[t] = here
    moves = np.zeros((n, n))
    back = np.ones((size, n))
    p = np.empty((size, most, n))
    for t in range(most - 1, -1, -1):
        p[:, t] = ahead[t] * back
        if t:
            come = back * push[:, t]
            total = ((ahead[t - 1] @ step) * come).sum(axis=1, keepdims=True)
            moves += step * (ahead[t - 1].T @ (come / total))
            back = come @ step.T
            back /= back.sum(axis=1, keepdims=True)
    return p / p.sum(axis=2, keepdims=True), moves


def _training_sequences(rows: list[tuple[int, list[str]]]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """(word types, (type, label) of each word by sequence length): two pieces of up to PIECE words each, half of them with a switch."""
    number: dict[str, int] = {}
    whole = [(y, np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32)) for y, words in rows]
    pieces = [(y, ids[i : i + PIECE]) for y, ids in whole for i in range(0, len(ids), PIECE)]
    by_label: dict[int, list[np.ndarray]] = {}
    for y, ids in pieces:
        by_label.setdefault(y, []).append(ids)
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    turn: Counter[int] = Counter()
    names = sorted(by_label)
    for i, (y, ids) in enumerate(pieces):
        if i % 2:
            other = names[(names.index(y) + 1 + i // 2 % max(1, len(names) - 1)) % len(names)]
        else:
            other = y
        next_ids = by_label[other][turn[other] % len(by_label[other])]
        labels = np.repeat([y, other], [len(ids), len(next_ids)])
        by_length.setdefault(len(labels), []).append((np.concatenate((ids, next_ids)), labels))
        turn[other] += 1
    return list(number), [tuple(map(np.array, zip(*by_length[n]))) for n in sorted(by_length)]


def train(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> Model | None:
    """A model of (label, text) rows, by steps along the gradient of the sequences' log-likelihood with a scale for each weight."""
    worded = [(y, words) for y, text in rows if (words := words_of(text))]
    labels = sorted({y for y, _ in worded})
    if not labels:
        return None
    number = {y: i for i, y in enumerate(labels)}
    split = [(number[y], words) for y, words in worded]
    counts = [Counter() for _ in labels]
    for y, words in split:
        counts[y].update(words)
    lexicon: dict[str, int] = {}
    for y, own in enumerate(counts):
        for word, n in sorted(own.most_common(), key=lambda x: (-x[1], x[0])):
            if len([1 for v in lexicon.values() if v == y + 1]) >= LEXICON or n < 5:
                break
            if n >= 5 * sum(c[word] for i, c in enumerate(counts) if i != y):
                lexicon[word] = y + 1
    model = Model(labels, lexicon)
    if len(labels) == 1:
        return model
    names, groups = _training_sequences(split)
    n, size = len(labels), sum(types.size for types, _ in groups)
    bucket, place, starts = grams(names)
    begin = np.searchsorted(place, starts)
    owner = np.repeat(np.arange(len(names)), np.diff(np.concatenate((begin, [len(bucket)]))))
    listed = np.array([lexicon.get(w, 0) for w in names])
    flat, gold = (np.concatenate([g[k].reshape(-1) for g in groups]) for k in (0, 1))
    # What the labelled words show of each weight; the model's own expectation is taken off it in each round.
    seen = np.zeros((len(names), n))
    np.add.at(seen, (flat, gold), 1)
    moves = np.zeros((n, n))
    for _, truth in groups:
        np.add.at(moves, (truth[:, :-1].reshape(-1), truth[:, 1:].reshape(-1)), 1)
    firsts = np.bincount(np.concatenate([truth[:, 0] for _, truth in groups]), minlength=n).astype(float)
    weights = [model.gram.astype(np.float64), model.listed.astype(np.float64), model.move, model.first]
    squares = [np.full_like(w, 1e-8) for w in weights]
    for _ in range(rounds):
        scores = np.add.reduceat(weights[0].astype(np.float32)[bucket], begin, axis=0) + weights[1][listed]
        joint, expected = zip(*(expectations(scores[types], weights[2], weights[3]) for types, _ in groups))
        p = np.concatenate([j.reshape(-1, n) for j in joint])
        expected_moves, expected_firsts = sum(expected), sum(j[:, 0].sum(axis=0) for j in joint)
        expected = np.stack([np.bincount(flat, weights=p[:, y], minlength=len(names)) for y in range(n)], axis=1)
        off = seen - expected
        grad = [
            np.stack([np.bincount(bucket, weights=off[owner, y], minlength=BUCKETS) for y in range(n)], axis=1),
            np.stack([np.bincount(listed, weights=off[:, y], minlength=n + 1) for y in range(n)], axis=1),
            moves - expected_moves,
            firsts - expected_firsts,
        ]
        grad[1][0] = 0
        for w, s, g in zip(weights, squares, grad):
            g = g / size - 1e-7 * w
            s += g * g
            w += 0.15 * g / np.sqrt(s)
    model.gram, model.listed = weights[0].astype(np.float32), weights[1].astype(np.float32)
    model.move, model.first = weights[2], weights[3]
    return model


def fair_share(lengths: list[int], total: int) -> int:
    """The largest length that all texts can be cut to for their sum to be within ``total``; shorter texts leave theirs to longer ones."""
    left = total
    for i, n in enumerate(sorted(lengths)):
        share = left // (len(lengths) - i)
        if n > share:
            return max(1, share)
        left -= n
    return max(lengths, default=1)


def training_rows(
    docs: DataFrame, limit: int = TRAIN_LIMIT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = TRAIN_CHARS
) -> list[tuple[str, str]]:
    """(lang, text) of the labelled training rows: the first of each language, then those that come first by hash; repeated rows count once.

    Texts that together exceed ``train_chars`` are cut on the executors to one
    common length, at the end of a word.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    own = own.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2).withColumn("copy", F.xxhash64("text"))
    # Keys first, so that the sort holds no text.
    place = F.struct(F.xxhash64("id").alias("h"), "id", "copy").alias("place")
    keys = own.select("lang", place, F.char_length("text").alias("n")).distinct()
    firsts = own.groupBy("lang").agg(F.min(place).alias("place")).orderBy("place", "lang").limit(limit).withColumn("first", F.lit(True))
    ordered = keys.join(F.broadcast(firsts), ["lang", "place"], "left").orderBy(F.col("first").isNull(), "place", "lang").limit(limit)
    chosen = ordered.select("place.id", "lang", "place.copy", "n")
    picked = chosen.collect()
    if not picked:
        return []
    most = fair_share([r.n for r in picked], train_chars)
    picked = F.broadcast(docs.sparkSession.createDataFrame(picked, chosen.schema))
    head = F.when(F.col("n") > most, F.substring(F.regexp_replace("text", r"^[^\p{L}]+", ""), 1, most)).otherwise(F.col("text"))
    rows = own.join(picked, ["id", "lang", "copy"]).groupBy("id", "lang", "copy", "n").agg(F.min(head).alias("text")).select("id", "lang", "text", "n")
    out = []
    for _, lang, text, n in sorted(map(tuple, rows.toLocalIterator()), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1], r[2])):
        whole = n <= most or len(text) < most
        out.append((lang, text if whole else re.sub(r"(?<=\s)\S+$", "", text)))
    return out


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_limit: int = TRAIN_LIMIT,
    with_words: bool = False,
    train_chars: int = TRAIN_CHARS,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score[, word_langs]) of each row; with_words gives every word's language."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(training_rows(docs, train_limit, id_col, text_col, lang_col, train_chars)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double" + (", word_langs array<string>" if with_words else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        for batch in small_batches(batches, ROWS):
            ids = batch.column("doc_id")
            found = labeller(batch.column("text").to_pylist(), with_words)
            held = [zlib.crc32(("" if x is None else str(x)).encode()) % 4 == 2 for x in ids.to_pylist()]
            columns = [ids, pa.array(held), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if with_words:
                columns.append(pa.array([f[2] for f in found], pa.list_(pa.string())))
                names.append("word_langs")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(run, schema)


class Labeller:
    """Labels texts; emissions of the words met first are remembered, others last for a call."""

    def __init__(self, model: Model | None, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.number: dict[str, int] = {}
        self.known = np.zeros((0, len(model.labels) if model else 0), dtype=np.float32)

    def __call__(self, texts: list[str | None], with_words: bool = False) -> list[tuple]:
        model, number = self.model, self.number
        if model is None:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        new: list[str] = []
        old = len(number)
        ids: list[np.ndarray] = []
        for text in texts:
            words = words_of(text)
            for w in set(words).difference(number):
                number[w] = len(number)
                new.append(w)
            ids.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
        table = np.concatenate((self.known, model.emissions(new))) if new else self.known
        if old < self.limit:
            self.known = table
        else:
            for w in new:
                del number[w]
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        p = forward_backward(table[np.concatenate(ids)] if lengths.sum() else table[:0], lengths[lengths > 0], model.move, model.first)
        ends = np.cumsum(lengths)
        out = []
        for n, end in zip(lengths.tolist(), ends.tolist()):
            if not n:
                out.append((UNKNOWN, 0.0, []))
                continue
            own = p[end - n : end]
            mean = own.mean(axis=0)
            best = int(mean.argmax())
            out.append((model.labels[best], min(1.0, float(mean[best])), [model.labels[i] for i in own.argmax(axis=1)] if with_words else []))
        return out
