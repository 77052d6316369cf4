"""Encoding and decoding with a merge model, against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
from spindle.llm import sentencepiece_bpe as S


@pytest.fixture(scope="module")
def model():
    return S.Model(S.model_bytes()).for_encoding()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=S.model_bytes())


def ids(model, text, end=True):
    return np.frombuffer(model.encode(text, end), np.int32).tolist()


def test_encoding_is_the_librarys(model, library):
    draw = random.Random(3)
    marks = ["a", "b", "th", " ", "  ", "▁", "\n", "é", "中", "😀", "‍", "0", "ing", "<0x41>", "</s>", "\x00", "ü", "==", "ка"]
    texts = ["".join(draw.choice(marks) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(draw.choice(list(model.ids)) for _ in range(draw.randint(1, 6))) for _ in range(4000)]
    texts += [f"a{' ' * k}b" for k in range(60)] + ["=" * k for k in range(60)] + ["ab" * 5000, "中文" * 3000, "x" * 20_000]
    for t in texts:
        assert ids(model, t) == library.encode(t, add_eos=True), t[:80]
        assert model.decode(ids(model, t)) == library.decode(library.encode(t, add_eos=True)), t[:80]


def test_decoding_any_ids_is_the_librarys(model, library):
    draw = random.Random(4)
    for _ in range(5000):
        some = [draw.choice([draw.randrange(32_000), draw.randrange(3, 259), draw.randrange(3, 259), 0, 1, 2, 28705, 259]) for _ in range(draw.randint(0, 8))]
        assert model.decode(some) == library.decode(some), some


def test_a_failed_position_is_left_by_shorter_pieces(model):
    """Units whose longest first piece is not the first piece of the encoding."""
    word = next(p for p in model.ids if len(p) > 3 and model.merged(p + "s")[0] != p and len(model.merged(p)) == 1)
    assert model.pieces_of(word + "s") == model.merged(word + "s")
    long = (word + "s") * (5000)
    assert "".join(model.pieces_of(long)) == long and all(model.fits(a, b) for a, b in zip(model.pieces_of(long), model.pieces_of(long)[1:], strict=False))


def test_kept_units_are_bounded(model, monkeypatch, library):
    monkeypatch.setattr(S, "UNITS", 10)
    monkeypatch.setattr(S, "PAIRS", 5)
    text = " ".join(f"word{i} and number {i % 7}" for i in range(200))
    assert ids(model, text) == library.encode(text, add_eos=True) and len(model.known) <= 11 and len(model.older) <= 11


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "two words", "x"), (3, "two words", "x"), (None, "é" * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = S.decoded(S.encoded(docs, S.model_bytes()), S.model_bytes()).collect()
    assert len(got) == 5 and {r["_token_ids"] for r in got} == {"x", None}
    for r in got:
        assert r["token_ids"] == library.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "")
    assert S.decoded(docs.selectExpr("cast(null as array<int>) as token_ids"), S.model_bytes()).first().decoded is None
    assert S.encoded(docs.limit(0), S.model_bytes()).count() == 0
    with pytest.raises(ValueError):
        S.encoded(docs.drop("text"), S.model_bytes())


def test_query_rows(spark, sf, library):
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(found), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, found)), library.decode(found)))))
    got = entry.queries()["op12_sentencepiece"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, got.collect())) == sorted(want)
