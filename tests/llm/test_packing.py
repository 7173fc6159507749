import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import packing as P
from tallyloom.llm.tokens import ChunkEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "Hello, World. it's we'll 'tis ÉCOLE, é. ΟΔΟΣ, Σ. İstanbul. ﬀ, ₤. á, 12. x_y. <|endoftext|> A<|ENDOFTEXT|>b a...  b,,  c d, ß. 日本, ",
    "\x1c a\x1cb. ﬁ. Ⅷ, é́. ́, x́. K. Å, 　",
    "",
    "a\x0bb\x0cc\x85d",
]


def test_chunks_give_the_tokenizers_ids(texts):
    encoder = ChunkEncoder(PATH, limit=50)
    for batch in (ODD, [t for t in texts if t], ODD):
        for text, ids in zip(batch, encoder.encode_batch(batch)):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids == np.array(want, dtype="<u4").tobytes()


def test_random_text_gives_the_tokenizers_ids():
    rng = random.Random(7)
    ranges = [(97, 123), (65, 91), (0xC0, 0x250), (0x130, 0x131), (0x300, 0x330), (0x370, 0x530), (0x1E00, 0x2000), (0x3040, 0x3100), (0xFB00, 0xFB50), (32, 48), (0x21, 0x2FFF), (0xA640, 0xABFF), (0x10280, 0x10400)]

    def letter():
        return chr(rng.randrange(*rng.choice(ranges)))

    made = ["".join(letter() for _ in range(rng.randint(1, 6))) + rng.choice([",", ".", "", " ", "., "]) for _ in range(10_000)]
    made += ["İ.", "TARİHİ, yok", "İ, ı. ŉ, ǰ. ẞ. Å, ª. º,"]
    encoder = ChunkEncoder(PATH)
    want = encoder.tokenizer.encode_batch(made, add_special_tokens=False)
    assert encoder.encode_batch(made) == [np.array(w.ids, dtype="<u4").tobytes() for w in want]


def test_tokenizer_that_minds_white_space(texts):
    encoder = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_chunks
    for text, ids in zip(ODD, encoder.encode_batch(ODD)):
        assert ids == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert ChunkEncoder(PATH).by_chunks and encoder.encode_batch([None]) == [b""]


def test_pieces_and_places(docs, rows):
    got = P.pack_documents(docs, PATH, with_ids=True).collect()
    tokenizer = ChunkEncoder(PATH).tokenizer
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, i, min(2048, len(ids) - i)) for k, i in enumerate(range(0, len(ids), 2048))]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, dtype="<u4").tobytes()
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(r.length for r in got) // 2048) + 1
    whole = P.sequences(P.pack_documents(docs, PATH, with_ids=True)).collect()
    assert sorted(r.length for r in whole) == sorted(filled.values())


def placed(plan):
    bins = {}
    for n, _, count, first, offset in plan.steps:
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, n))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_sound_and_tight(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([0, 1, 30, 3000])):
        n = min(100, max(1, int(rng.lognormvariate(3, 1))))
        counts[n] = counts.get(n, 0) + 1
    plan = P.Plan(dict(counts), 100)
    bins = placed(plan)
    assert set(bins) == set(range(plan.sequences))
    seen = {}
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
            seen[n] = seen.get(n, 0) + 1
        assert at <= 100
        assert sum(3 * n > 100 for _, n in items) <= 2
    assert seen == counts
    lower = -(-sum(n * c for n, c in counts.items()) // 100)
    large = sum(c for n, c in counts.items() if 2 * n > 100)
    assert plan.sequences <= max(lower, large) * 1.05 + 2


def test_large_items_pair():
    plan = P.Plan({60: 3, 40: 2, 35: 1, 5: 1}, 100)
    assert plan.sequences == 3


def fewest(items, capacity):
    """The least number of bins, by trying every bin for each item, largest first."""
    best = len(items)

    def place(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[at] <= capacity and bins.index(bins[k]) == k:
                place(at + 1, [*bins[:k], bins[k] + items[at], *bins[k + 1 :]])
        place(at + 1, [*bins, items[at]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_small_plans_are_next_to_the_optimum(seed):
    rng = random.Random(seed)
    for _ in range(20):
        items = sorted((rng.randint(3, 100) for _ in range(9)), reverse=True)
        plan = P.Plan({n: items.count(n) for n in items}, 100)
        assert plan.sequences <= fewest(items, 100) + 1


def test_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 20)
    rows = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "CAST(IF(id % 3 = 0, 100, 1 + id % 700) AS long) AS length").repartition(5)
    filled = {}
    for r in sorted(P.pack(rows, 700).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert len(filled) <= -(-sum(filled.values()) // 700) * 1.02 + 1 and max(filled.values()) <= 700


def test_empty_and_repeated(nothing, repeated):
    assert P.pack_documents(nothing, PATH).count() == 0
    got = P.pack_documents(repeated, PATH).collect()
    assert len(got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == 6
