import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import language_id as I
from tallyloom.llm import toxicity as T


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    move, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([1, 4, 2])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    got = I.forward_backward(scores, lengths, move, first)
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(first[path[0]] + sum(own[t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += w
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-6)
        at += n


def test_expected_moves_equal_enumeration():
    rng = np.random.default_rng(2)
    move, first, scores = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(1, 4, 2))
    _, got = I.expectations(scores, move, first)
    want, total = np.zeros((2, 2)), 0.0
    for path in itertools.product(range(2), repeat=4):
        w = np.exp(first[path[0]] + sum(scores[0, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += w
        for a, b in zip(path, path[1:]):
            want[a, b] += w
    assert np.allclose(got, want / total, atol=1e-6)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = I.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switches_and_gaps(spark):
    en, de = "the and of with that this from which there under ", "und der nicht einer auch werden durch über schon noch "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 12, "en" if i % 2 else "de") for i in range(60)] + [(100, en * 2 + de * 3, None), (101, None, "en"), (102, "12 34 !? ² ½", None), (103, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in I.identify(docs, with_words=True).collect()}
    assert got[100].lang_pred == "de" and got[100].word_langs == ["en"] * 20 + ["de"] * 30
    assert {got[i].lang_pred for i in (101, 102, 103)} == {"und"} and got[103].score == 0
    none = I.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_long_text_in_one_call():
    model = I.train([("a", "aa ab aba abba " * 40), ("b", "zz zy zyz zyyz " * 40)])
    label = I.Labeller(model, limit=2)
    first = label(["aba " * 30_000, "zyz", None, "aba zyz qqq"], True)
    assert [f[0] for f in first[:3]] == ["a", "b", "und"]
    assert label(["zyz"])[0][0] == "b"


def test_short_texts_train():
    en, de = "the and of with that this from which".split(), "und der nicht einer auch werden durch schon".split()
    rows = [(y, " ".join(own[(i + k) % 8] for k in range(1 + i % 5))) for i in range(40) for y, own in (("de", de), ("en", en))]
    label = I.Labeller(I.train([*rows, ("aa", "12 34")]))
    assert [f[0] for f in label(["the and", "und der", "which", "schon auch nicht"])] == ["en", "de", "en", "de"]
    assert min(f[1] for f in label(["the and of", "und der nicht"])) > 0.9
    assert I.train([("aa", "12 34")]) is None


def test_one_language_of_short_texts_only_trains():
    long, short = "the and of with that this from which " * 8, ["und der", "nicht einer auch", "werden durch", "schon und der"]
    label = I.Labeller(I.train([("en", long)] * 5 + [("de", t) for t in short] * 5))
    assert [f[0] for f in label(["der und nicht", "the and with"])] == ["de", "en"]


def test_every_word_stands_in_a_sequence():
    rows = [(0, [f"a{i}" for i in range(37)]), (1, ["b0", "b1", "b2"])]
    names, groups = I._training_sequences(rows)
    assert {names[i] for types, _ in groups for i in types.reshape(-1)} == {w for _, words in rows for w in words}
    assert all((names[i][0] == "b") == (y == 1) for types, truth in groups for i, y in zip(types.reshape(-1), truth.reshape(-1)))


def test_long_rows_leave_every_row_and_language_in_training(spark):
    en, de, fr = "the and of with that this from which ", "und der nicht einer auch werden durch ", "les des dans pour une avec sont cette "
    docs = spark.createDataFrame([(i, (en, de)[i % 2] * (3000 if i < 40 else 5), ("en", "de")[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    rows = I.training_rows(docs, train_chars=100_000)
    taken = [i for i in range(60) if I.zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(y for y, _ in rows) == sorted(("en", "de")[i % 2] for i in taken)
    assert 90_000 < sum(len(t) for _, t in rows) <= 100_000
    assert {w for _, t in rows for w in t.split()} == {*en.split(), *de.split()}
    # The default bound, which one row alone reaches.
    long = docs.limit(0).union(spark.createDataFrame([(i, (en, de)[i % 2] * 90_000, ("en", "de")[i % 2]) for i in range(8)], docs.schema))
    assert {y for y, _ in I.training_rows(long)} == {"en", "de"} and sum(len(t) for _, t in I.training_rows(long)) <= I.TRAIN_CHARS
    # A language of one row beyond the limit, and a row that repeats.
    rare = docs.union(spark.createDataFrame([(i, fr, "fr") for i in (1003, 1003)], docs.schema))
    got = I.training_rows(rare, limit=3)
    assert len(got) == 3 and {y for y, _ in got} == {"en", "de", "fr"}


DISGUISES = {"1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "m0r0n": "moron", "$cum": "scum", "looooser": "loser", "i - d - i - o - t": "idiot", "L  0  S  E  R": "loser", "tr@sh": "trash", "you i d i o t now": "you idiot now", "plain words": "plain words"}


def model():
    words = ("idiot moron scum loser trash you now plain words are the and of river town people walk there " * 40).encode()
    table = np.frombuffer(T._TABLE, dtype=np.uint8)
    s = np.concatenate(([0, 0, 0], table[np.frombuffer(words, dtype=np.uint8)])).astype(np.int64)
    grams = ((s[:-3] * T.SYMBOLS + s[1:-2]) * T.SYMBOLS + s[2:-1]) * T.SYMBOLS + s[3:]
    return T.log_model(np.bincount(grams, minlength=T.SYMBOLS**4))


def test_restoring():
    restorer = T.Restorer(model())
    assert {k: restorer(k) for k in DISGUISES} == DISGUISES


def test_lines_without_signs_are_left_as_they_are():
    restorer = T.Restorer(model())
    odd = ["A b. c", "x\ny z", None, "", "mail5.example.com\nL0SER here\nplain", "é é é", "a b c", "ends in l o s e r", "1 2 3", "aaa\n\nbbb", "no-one"]
    assert list(restorer.column(pa.array(odd, pa.string()))) == [restorer(t or "") for t in odd]


#: The same stretches as one pattern, whose search is quadratic in an unbroken run.
_L, _G = T._leet, T._gap
WHOLE = re.compile(
    rf"(?<![^{_G}\n\t\r])[a-z{_L}](?:[{_G}]{{1,3}}[a-z{_L}]){{2,}}(?=[{_G}\n\t\r]|\Z)"
    rf"|[^\s.,;:]*[^\W\d_][{_L}]+[^\W\d_][^\s,;:]*"
    rf"|(?<!\S)[{_L}]+[^\W\d_]{{2,}}[^\s,;:]*"
    r"|[^\W\d_]{2,}[0-9@$]+(?=[\s.,;:]|$)"
    r"|[^\s]*?([a-z])\1\1+[^\s,;:]*"
)


def test_stretches_equal_the_pattern():
    rng = random.Random(3)
    alphabets = ["ab1 .", "aab1@, .-", "aaab \n", "abé1$!;:._*~ \t\n", "a1(|+x ", "aabbb11.,: "]
    for i in range(30_000):
        text = "".join(rng.choice(alphabets[i % 6]) for _ in range(rng.randint(0, 24)))
        assert list(T.stretches(text)) == [m.span() for m in WHOLE.finditer(text)], repr(text)


def test_grams_do_not_cross_texts():
    texts, want = ["ab  c", "", "  ", "Ü!", "a", " b. "], Counter()
    for text in texts:
        own = T._TABLE[0:0] + bytes(T._TABLE[b] for b in text.encode())
        kept = [b for i, b in enumerate(own) if b or i and own[i - 1]]
        if kept:
            s = [0, 0, 0, *kept, 0]
            want.update(((s[i] * 28 + s[i + 1]) * 28 + s[i + 2]) * 28 + s[i + 3] for i in range(len(s) - 3))
    raw = "".join(texts).encode()
    symbols = np.frombuffer(T._TABLE, dtype=np.uint8)[np.frombuffer(raw, dtype=np.uint8)].astype(np.int32)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    assert Counter(T.grams_of(symbols, offsets).tolist()) == want
    assert not len(T.grams_of(np.zeros(0, dtype=np.int32), np.zeros(3, dtype=np.int64)))


def test_restoring_finds_the_cheapest_reading():
    """Every reading of short stretches, with its cost by the channel and the character model."""
    table, rng = model(), random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("idot10$.o ") for _ in range(rng.randint(1, 6)))
        runs = [len(list(g)) for _, own in itertools.groupby(text) for g in [list(own)] for _ in g]
        best = {}
        for way in itertools.product(*[T._choices(c, text[i - 1] if i else "", runs[i]) for i, c in enumerate(text)]):
            cost, state = 0.0, 0
            for symbol, _, channel in way:
                cost += channel
                if symbol >= 0:
                    cost += float(table[state * T.SYMBOLS + symbol])
                    state = (state * T.SYMBOLS + symbol) % T.SYMBOLS**3
            reading = "".join(letter for _, letter, _ in way)
            best[reading] = max(best.get(reading, -1e9), cost + float(table[state * T.SYMBOLS]))
        assert best[T.restore(text, table)] == pytest.approx(max(best.values()), abs=1e-6)


def test_long_unbroken_text_takes_linear_time():
    rng = random.Random(1)
    restorer = T.Restorer(model())
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters + "0123456789+/") for _ in range(1_000_000)), "ab" * 500_000, ("ab" * 40 + "/") * 12_000, "a1" * 200_000]
    for text in texts:
        began = time.process_time()
        assert restorer(text)
        assert time.process_time() - began < 60


def test_scores_equal_a_plain_sum(spark):
    """Every score from the restored words, weight by weight, and features by a count in plain Python."""
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "loser"), (7, "l o s e r"), (7, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9000, None), (3, 0)], "doc_id long, toxic int")
    table = T.log_model(T.model_counts(docs))
    counts = T.model_counts(docs)
    assert counts.sum() > 0 and np.array_equal(counts, T.model_counts(docs.repartition(7)))
    labelled = T.labelled_rows(labels)
    assert labelled == {i: y for i, _, y in rows if T.in_training(i)}
    weights, intercept = T.fit(docs, labelled, table)
    restorer = T.Restorer(table)
    total, positive, n, t = len(labelled), sum(labelled.values()), Counter(), Counter()
    for i, text, y in rows:
        if i in labelled:
            own = {f for w in set(T._WORD.findall(restorer(text))) for f in T.features(w)}
            n.update(own)
            t.update(own if y else [])
    own = [7] if 7 in labelled else []  # the rows that repeat a labelled id count like any other
    for i, text in ((7, "l o s e r"), (7, "")):
        if own:
            found = {f for w in set(T._WORD.findall(restorer(text))) for f in T.features(w)}
            n.update(found)
            t.update(found if labelled[7] else [])
    base = positive / total

    def evidence(f):
        part = lambda k, e: k * np.log(k / e) if k else 0.0
        return 2 * (part(t[f], n[f] * base) + part(n[f] - t[f], n[f] * (1 - base)))

    assert set(weights) <= {f for f in n if n[f] >= 3 and t[f] > n[f] * base and evidence(f) >= T.MIN_EVIDENCE}
    for r in T.score(docs, labels, with_text=True).collect():
        words = set(T._WORD.findall(r.restored_text))
        z = intercept + sum(weights.get(f, 0.0) for w in words for f in T.features(w))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))
        assert r.predicted == (r.score >= 0.3)


def toxic_rows():
    mild, foul = "the river runs along the town and people walk there ", ["idiot", "moron", "loser"]
    texts = [(i, mild * 3 + (foul[i % 3] + " and " if i % 4 == 0 else "") + f"w{i}", int(i % 4 == 0)) for i in range(400)]
    return texts


def test_scores(spark):
    rows = toxic_rows()
    extra = [(1001, "the river and l o s e r walk there"), (1002, "you 1D10T, the town"), (1003, "the people walk"), (1004, None), (1005, "")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)
    assert [got[i].predicted for i, _ in extra] == [1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1004].score == got[1005].score
    assert got[2].held_out == (not T.in_training(2))
    clear = T.score(docs.filter("doc_id = 1001"), labels, with_text=True).first().restored_text
    assert clear.split()[0] == "the"


def test_no_labels_and_no_rows(spark, nothing, repeated):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.score(nothing, none).count() == 0
    got = T.score(repeated, none).collect()
    assert len(got) == 6 and len({r.score for r in got}) == 1
    assert I.identify(nothing).count() == 0 and I.identify(repeated).count() == 6
