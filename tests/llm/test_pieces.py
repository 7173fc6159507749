import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from tallyloom.llm import pieces as P
from tallyloom.llm import queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"abcdeth  \n\t.,AZ09▁éüßñ中文😀́​\x00<>s/|_-", *map(chr, range(0x410, 0x430)), "the", "ing", "<s>", "<0x0A>", "  ", "e, ", "n.", " www."]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return P.PieceEncoder(MODEL)


def made(seed, n=1500, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_ids_and_spans_equal_the_library(library, own):
    texts = made(1)
    for text, (ids, starts, ends) in zip(texts, own.encode_batch(texts)):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == library.encode(text, add_eos=True)
        size = len(text.encode())
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want] + [(size, size)]


def test_spans_tile_the_text(own):
    for text, (_, starts, ends) in zip(made(2, 300), own.encode_batch(made(2, 300))):
        raw = text.encode()
        assert b"".join(raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())) == raw
        assert all(a <= z for a, z in zip(starts, ends)) and all(z == a for z, a in zip(ends, starts[1:]))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nfkc", "identity"])
def test_normal_forms_equal_the_library(rule):
    theirs = SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(theirs.serialized_normalizer_spec())
    ours = P.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
    rng = random.Random(3)
    letters = list("ab  ﬁ①ＡＢｶﾞ　 é é …Å㌔​ß İ\t\n▁")
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 15)))
        want, offsets = theirs.normalize(text, with_offsets=True)
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        normal, source = ours.run(text)
        assert normal.replace(P.MARK, " ") == want.replace(P.MARK, " ") and source.tolist() == [at[o] for o in offsets]


def test_long_runs(library, own):
    rng = random.Random(9)
    long = ["".join(rng.choice("abcdefgh") for _ in range(30_000)), " " * 5000 + "x", "\n" * 999, "word " * 2000, "é" * 4000, "." * 3000]
    for text, (ids, _, _) in zip(long, own.encode_batch(long)):
        assert ids.tolist() == library.encode(text, add_eos=True)


def test_operator(spark, docs, rows, nothing, repeated, library):
    got = {r.doc_id: r for r in P.decode(P.encode(docs, MODEL, keep=("words",), prefix="new_"), MODEL, "new_ids").collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert r.new_ids == library.encode(text or "", add_eos=True) and r.decoded == library.decode(r.new_ids) and r.words == "w"
        assert len(r.new_starts) == len(r.new_ends) == len(r.new_ids)
        assert r.decoded == (text or "")
    assert P.encode(nothing, MODEL).count() == 0 and P.encode(repeated, MODEL).count() == 6
    assert {tuple(r.ids) for r in P.encode(repeated.filter("text is null"), MODEL).collect()} == {(2,)}


def test_refuses_other_models(tmp_path):
    spec = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        spec.ParseFromString(f.read())
    spec.pieces[500].type = P.USER
    (tmp_path / "m").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        P.PieceEncoder(str(tmp_path / "m"))


def test_query(spark, library, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op12_sentencepiece(spark, tiny).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
