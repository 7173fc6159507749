"""Toxicity scores after noisy-channel deobfuscation.

Channel: a stretch of text that looks disguised (digits or symbols among
letters, letters repeated three times or more, letters set apart by blanks or
marks) is read as a lattice: a character may stand for the letters it
imitates, a repeat or a separator may stand for nothing.  The cheapest path
under channel costs plus a character 4-gram model is found by exact Viterbi
and replaces the stretch.  The model's counts come from all documents.

Score: a logistic model over words and word stems of the restored text.  Its
features are those whose labelled documents are toxic too often for chance
(a likelihood-ratio test; the ``max_features`` with the most evidence), its
weights fitted by Newton steps.  Both use the ``train_limit`` labelled
training rows that come first by hash; the training rows are those whose
crc32(id as text) mod 4 is not 2.

Defined results: null and wordless texts get the score of no evidence; rows
that repeat a doc_id are scored each on their own text; texts of any length
are scored whole; other columns are dropped; without labelled rows
all scores equal the prior; an empty table gives an empty result.

Scale: three scans, no shuffle of text, time linear in a text's length however
few blanks it has; the 4-gram table, the features and the labelled sample are
bounded and broadcast.
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

from tallyloom.llm.common import named, ship, small_batches, written
from tallyloom.llm.quality_rules import _texts

TRAIN_LIMIT = 20_000
MAX_FEATURES = 2_000
MIN_EVIDENCE = 30.0
THRESHOLD = 0.3
RIDGE = 0.05
STEMS = (4, 5, 6, 7)

# The letters that a character may imitate.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
}
_SEPARATORS = " .-_*~"

#: Symbols of the character model: 0 is a boundary, 1-26 letters, 27 any other letter.
SYMBOLS = 28
_TABLE = bytes(27 if b >= 128 else (b | 32) - 96 if chr(b).isalpha() else 0 for b in range(256))

_leet = re.escape("".join(LEET))
_gap = re.escape(_SEPARATORS)
# What looks disguised in lower-case text.  A stretch begins as far left as its kind allows; kinds come in this order.
#: s p a c e d, s.p.a.c.e.d: blanks only set single characters apart.
_SPACED = re.compile(rf"(?<![^{_gap}\n\t\r])[a-z{_leet}](?:[{_gap}]{{1,3}}[a-z{_leet}]){{2,}}(?=[{_gap}\n\t\r]|\Z)")
#: w1thin: each letter with signs and another letter after it; the stretch is from the segment's start to the next blank or comma.
_WITHIN = re.compile(rf"[^\W\d_](?=[{_leet}]+[^\W\d_])")
#: 1nitial, to the next blank or comma.
_INITIAL = re.compile(rf"(?<!\S)[{_leet}]+[^\W\d_]{{2,}}[^\s,;:]*")
#: fina1: the signs after two letters or more at the end of a word.
_FINAL = re.compile(r"(?<=[^\W\d_]{2})[0-9@$]+(?=[\s.,;:]|$)")
#: repeeeated: three of a letter; the stretch is from the blank before to the next blank or comma.
_REPEATED = re.compile(r"([a-z])\1\1+")
_SEGMENT, _PIECE, _TOKEN = re.compile(r"[^\s.,;:]+"), re.compile(r"[^\s,;:]+"), re.compile(r"\S+")
_LETTERS_BEFORE = re.compile(r"[^\W\d_]+")


def _around(marks: list[int], runs: re.Pattern, text: str) -> list[tuple[int, int]]:
    """(start, end) of the run that holds each mark; both in order, each run looked at once."""
    out, at = [], 0
    for run in runs.finditer(text):
        while at < len(marks) and marks[at] < run.end():
            out.append(run.span())
            at += 1
        if at == len(marks):
            break
    return out


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each disguised stretch of lower-case text, in time linear in its length.

    Each kind but the first is a list of (least start, largest start, end): a
    stretch may start anywhere between, wherever the one before ended.
    """
    kinds: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    cores = [m.start() for m in _WITHIN.finditer(text)]
    if cores:
        last: dict[tuple[int, int], int] = {}
        pieces = _around(cores, _PIECE, text)
        for core, (start, _), (_, end) in zip(cores, _around(cores, _SEGMENT, text), pieces):
            last[start, end] = core
        kinds[0] = [(start, core, end) for (start, end), core in last.items()]
    kinds[1] = [(m.start(), m.start(), m.end()) for m in _INITIAL.finditer(text)]
    finals = [(m.start(), m.end()) for m in _FINAL.finditer(text)]
    if finals:
        letters = _around([a - 1 for a, _ in finals], _LETTERS_BEFORE, text)
        kinds[2] = [(start, a - 2, end) for (start, _), (a, end) in zip(letters, finals)]
    repeats = [(m.start(), m.end() - 3) for m in _REPEATED.finditer(text)]
    if repeats:
        marks = [a for a, _ in repeats]
        before = -1
        for (_, most), (start, _), (_, end) in zip(repeats, _around(marks, _TOKEN, text), _around(marks, _PIECE, text)):
            kinds[3].append((max(start, before + 1), most, end))
            before = most
    at = [0] * 4
    pos, spaced = 0, _SPACED.search(text)
    while True:
        if spaced and spaced.start() < pos:
            spaced = _SPACED.search(text, pos)
        found = [(spaced.start(), 0, spaced.end())] if spaced else []
        for k, own in enumerate(kinds):
            while at[k] < len(own) and own[at[k]][1] < pos:
                at[k] += 1
            if at[k] < len(own):
                found.append((max(pos, own[at[k]][0]), k + 1, own[at[k]][2]))
        if not found:
            return
        start, _, end = min(found)
        yield start, end
        pos = end


def _byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_LEET = _byte_class("".join(LEET))
_IS_GAP = _byte_class(_SEPARATORS + "\n\t\r")
_IS_LETTER = np.array([chr(b | 32).isascii() and chr(b | 32).isalpha() or b >= 128 for b in range(256)])
_LOWERED = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def suspicions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running count, by byte, of signs of a disguised stretch: found over all texts at once, so that plain lines skip the patterns."""
    size = len(data)
    sign = np.zeros(size + 1, dtype=np.int64)
    if size >= 3:
        low = _LOWERED[data]
        letter = _IS_LETTER[data]
        sign[1 : size - 1] += (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[2:]
        leet = _IS_LEET[data]
        sign[1:size] += leet[:-1] & letter[1:]
        sign[1:size] += letter[:-1] & leet[1:]
        gap = _IS_GAP[data]
        before, after = np.concatenate(([True], gap[:-1])), np.concatenate((gap[1:], [True]))
        before[offsets[:-1][offsets[:-1] < size]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        alone = before & after & (leet | letter)
        for step in (2, 3, 4):
            if size > step:
                sign[1 : size - step + 1] += alone[:-step] & alone[step:]
    return np.cumsum(sign)


def grams_of(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol and at each end of several texts, none across texts; runs of boundaries count once, so that spacing does not drown the words."""
    before = np.concatenate(([0], symbols[:-1])) if len(symbols) else symbols
    before[offsets[:-1][offsets[:-1] < len(symbols)]] = 0
    keep = (symbols != 0) | (before != 0)
    starts = np.unique(np.concatenate(([0], np.cumsum(keep)))[offsets[:-1]])
    symbols = symbols[keep]
    starts = starts[starts < len(symbols)]
    # Before each text, the end of the one before and three boundaries.
    s = np.concatenate((np.insert(symbols, np.repeat(starts, 4), 0)[1:], [0])).astype(np.int32)
    ends = np.ones(len(s), dtype=bool)
    ends[((starts + 4 * np.arange(len(starts)))[:, None] + np.arange(3)).reshape(-1)] = False
    return (((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:])[ends[3:]]


def model_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character 4-grams over all documents, SYMBOLS ** 4 numbers."""
    ship(docs.sparkSession)
    size = SYMBOLS**4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(_TABLE, dtype=np.uint8)
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in _texts(batch.column("text")):
                grams = grams_of(table[data].astype(np.int32), offsets)
                sums += np.bincount(grams, minlength=size)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["gram", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram long, n long")
    sums = parts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # SYMBOLS ** 4 rows at most
    out = np.zeros(size)
    out[sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return out


def log_model(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """log p(symbol | three before), each order smoothed towards the next lower one."""
    c = counts.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        own = c.sum(axis=tuple(range(3 - order)))
        p = (own + strength * p) / (own.sum(axis=-1, keepdims=True) + strength)
    return np.log(p).astype(np.float32).reshape(-1)


def _choices(ch: str, before: str, run: int) -> list[tuple[int, str, float]]:
    """(symbol or -1 for nothing, letter, log cost) that a character may stand for."""
    if ch.isalpha():
        symbol = ord(ch) - 96 if "a" <= ch <= "z" else 27
        out = [(symbol, ch, 0.0 if run < 3 else -1.0)]
        if ch == before:
            out.append((-1, "", -0.2 if run >= 3 else -3.0))
        return out
    out = [(ord(x) - 96, x, -1.0) for x in LEET.get(ch, "")]
    if ch == before and ch in LEET:
        out.append((-1, "", -0.5 if run >= 3 else -2.5))
    if ch in _SEPARATORS:
        out.append((-1, "", -0.5))
    out.append((0, " ", -4.0 if ch.isdigit() or ch in "@$" else -1.5))
    return out


def restore(stretch: str, model: np.ndarray) -> str:
    """The cheapest reading of one disguised stretch of lower-case text."""
    runs, i = [], 0
    while i < len(stretch):
        j = i
        while j < len(stretch) and stretch[j] == stretch[i]:
            j += 1
        runs += [j - i] * (j - i)
        i = j
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # by the last three symbols
    before = ""
    for ch, run in zip(stretch, runs):
        new: dict[int, tuple[float, tuple]] = {}
        for state, (cost, path) in best.items():
            for symbol, letter, channel in _choices(ch, before, run):
                if symbol < 0:
                    total, to, way = cost + channel, state, path
                else:
                    gram = state * SYMBOLS + symbol
                    total, to, way = cost + channel + float(model[gram]), gram % SYMBOLS**3, (path, letter)
                if to not in new or total > new[to][0]:
                    new[to] = (total, way)
        best, before = new, ch
    _, path = max(((cost + float(model[state * SYMBOLS]), way) for state, (cost, way) in best.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Restores whole texts; readings of stretches of up to ``longest`` characters are remembered up to a bound."""

    def __init__(self, model: np.ndarray, limit: int = 200_000, longest: int = 100):
        self.model, self.limit, self.longest = model, limit, longest
        self.known: dict[str, str] = {}

    def _one(self, stretch: str) -> str:
        if len(stretch) > self.longest:
            return restore(stretch, self.model)
        found = self.known.get(stretch)
        if found is None:
            found = restore(stretch, self.model)
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[stretch] = found
        return found

    def __call__(self, text: str) -> str:
        low, at, out = text.lower(), 0, []
        for start, end in stretches(low):
            out += [low[at:start], self._one(low[start:end])]
            at = end
        return "".join([*out, low[at:]])

    def column(self, texts: pa.Array) -> Iterator[str]:
        """Every text of a column restored, nulls empty."""
        for row, data, offsets in _texts(texts):
            upto = suspicions(data, offsets)
            breaks = np.flatnonzero(data == 10)
            lines = np.searchsorted(breaks, offsets)
            found = upto[offsets[1:]] > upto[offsets[:-1]]
            for i in range(len(offsets) - 1):
                text = texts[row + i].as_py() or ""
                if not found[i]:
                    yield text.lower()
                    continue
                # No stretch crosses a line, so only lines with a sign are searched.
                ends = np.concatenate((breaks[lines[i] : lines[i + 1]], [offsets[i + 1]]))
                starts = np.concatenate(([offsets[i]], ends[:-1]))
                marked = (upto[ends] > upto[starts]).tolist()
                yield "\n".join([self(x) if m else x.lower() for x, m in zip(text.split("\n"), marked)])


_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word and its stems; a stem carries a mark that no word has."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]]


def in_training(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


def labelled_rows(labels: DataFrame, limit: int = TRAIN_LIMIT, id_col: str = "doc_id", label_col: str = "toxic") -> dict:
    """{id: label} of the training rows that come first by hash."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    own = own.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2).groupBy("id").agg(F.max("y").alias("y"))
    return {r[0]: r[1] for r in own.orderBy(F.xxhash64("id"), "id").limit(limit).collect()}


def fit(
    docs: DataFrame, labelled: dict, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_features: int = MAX_FEATURES, min_evidence: float = MIN_EVIDENCE
) -> tuple[dict[str, float], float]:
    """({feature: weight}, intercept) from the labelled documents; their restored words are written once."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((labelled, model))
    ids = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, table = known.value
        restorer = Restorer(table)
        for batch in small_batches(batches):
            ids = batch.column("id").to_pylist()
            mine = [i for i, doc_id in enumerate(ids) if doc_id in rows]
            words = [sorted(set(_WORD.findall(clear))) for clear in restorer.column(batch.column("text").take(pa.array(mine, pa.int64())))]
            yield pa.RecordBatch.from_arrays([pa.array([rows[ids[i]] for i in mine], pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["y", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for batch in small_batches(batches):
            for y, words in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist()):
                own = {f for w in words for f in features(w)}
                n.update(own)
                if y:
                    toxic.update(own)
        names = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())], names=["f", "n", "t"])

    total, positive = len(labelled), sum(1 for y in labelled.values() if y)
    if not 0 < positive < total:
        prior = (positive + 0.5) / (total + 1)
        return {}, float(np.log(prior / (1 - prior)))
    base = positive / total

    def part(k: F.Column, expected: F.Column) -> F.Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    n, t = F.col("n"), F.col("t")
    evidence = 2 * (part(t, n * base) + part(n - t, n * (1 - base)))
    sample = written(ids.mapInArrow(chosen, "y int, words array<string>"), "labelled")
    counts = sample.mapInArrow(count, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    strong = counts.filter((F.col("n") >= 3) & (t > n * base)).withColumn("g", evidence).filter(F.col("g") >= min_evidence)
    names = [r[0] for r in strong.orderBy(F.desc("g"), "f").limit(max_features).collect()]
    if not names:
        return {}, float(np.log(base / (1 - base)))
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = number.value
        for batch in small_batches(batches):
            xs = [sorted({at[f] for w in words for f in features(w) if f in at}) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(xs, pa.list_(pa.int32()))], names=["y", "x"])

    return _monotone(sample.mapInArrow(rows, "y int, x array<int>").groupBy("y", "x").count().collect(), names)  # train_limit rows at most


def _monotone(sample: list, names: list[str]) -> tuple[dict[str, float], float]:
    """A fit in which no feature speaks against toxicity: those that would are left out and the rest fitted again."""
    weights, intercept = _logistic(sample, names)
    while any(v < 0 for v in weights.values()):
        start = np.array([*[v for v in weights.values() if v >= 0], intercept])
        stays = [i for i, f in enumerate(names) if weights[f] >= 0]
        at = {i: k for k, i in enumerate(stays)}
        sample = [(r[0], [at[i] for i in r[1] if i in at], r[2]) for r in sample]
        names = [names[i] for i in stays]
        weights, intercept = _logistic(sample, names, start)
    return weights, intercept


def _logistic(sample: list, names: list[str], start: np.ndarray | None = None) -> tuple[dict[str, float], float]:
    """Ridge logistic regression by Newton steps; sample rows are (label, feature numbers, count).

    Rows with the same features and label come once with their count, and
    rows without any feature are two rows in all.
    """
    size = len(names) + 1  # the last is the intercept
    y = np.array([r[0] for r in sample], dtype=float)
    n = np.array([r[2] for r in sample], dtype=float)
    active = [np.array([*r[1], size - 1], dtype=np.int64) for r in sample]
    lengths = np.array([len(a) for a in active])
    row, col = np.repeat(np.arange(len(active)), lengths), np.concatenate(active)
    first = np.concatenate(([0], np.cumsum(lengths)))
    ridge = np.full(size, RIDGE)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = np.bincount(row, weights=w[col], minlength=len(y))
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(size) if start is None else start.copy()
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.bincount(row, weights=w[col], minlength=len(y))))
        slope = np.bincount(col, weights=(n * (y - p))[row], minlength=size) - ridge * w
        curve = np.zeros((size, size))
        for i in range(0, len(y), 1000):  # a block of rows at a time, to bound the memory
            j = min(len(y), i + 1000)
            block = np.zeros((j - i, size))
            block[row[first[i] : first[j]] - i, col[first[i] : first[j]]] = 1
            curve += (block * (n * p * (1 - p))[i:j, None]).T @ block
        step = np.linalg.solve(curve + np.diag(ridge), slope)
        scale = 1.0
        while (new := loss(w + scale * step)) > now and scale > 1e-4:
            scale /= 2
        w += scale * step
        if now - new < 1e-6 * max(1.0, now):
            break
        now = new
    return {f: round(float(v), 9) for f, v in zip(names, w)}, round(float(w[-1]), 9)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = THRESHOLD,
    train_limit: int = TRAIN_LIMIT,
    with_text: bool = False,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """(doc_id, held_out, score, predicted[, restored_text]) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    model = log_model(model_counts(docs, text_col))
    labelled = labelled_rows(labels, train_limit, "doc_id", label_col)
    weights, intercept = fit(docs, labelled, model, id_col, text_col, max_features)
    known = spark.sparkContext.broadcast((model, weights, intercept))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, held_out boolean, score double, predicted int" + (", restored_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, intercept = known.value
        restorer = Restorer(model)
        worth: dict[str, float] = {}
        for batch in small_batches(batches):
            z, restored = [], []
            for clear in restorer.column(batch.column("text")):
                total = intercept
                for word in set(_WORD.findall(clear)):
                    v = worth.get(word)
                    if v is None:
                        v = sum(weights.get(f, 0.0) for f in features(word))
                        if len(worth) >= 300_000:
                            worth.clear()
                        worth[word] = v
                    total += v
                z.append(total)
                restored.append(clear if with_text else None)
            s = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -50, 50)))
            ids = batch.column("doc_id")
            held = [not in_training("" if i is None else i) for i in ids.to_pylist()]
            columns = [ids, pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            names = ["doc_id", "held_out", "score", "predicted"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(restored, pa.string())] if with_text else [])], names=[*names, *(["restored_text"] if with_text else [])])

    return own.mapInArrow(run, schema)
