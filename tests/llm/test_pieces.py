"""Encoding and decoding against the sentencepiece library, on the public vocabulary and on small hand-made ones."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from docs_of import docs, edge_rows
from gridpulse.llm import pieces
from gridpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def _part(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    size = bytes([len(value) & 127 | 128, len(value) >> 7]) if len(value) > 127 else bytes([len(value)])
    return bytes([number << 3 | 2]) + size + value


def small_model(listed, kind=2, prefix=1, trims=0):
    """Model file of (piece, score, type) with a model type and two normaliser rules."""
    out = b"".join(_part(1, _part(1, p) + _part(2, float(s)) + _part(3, t)) for p, s, t in listed)
    byte_fallback = int(any(t == pieces.BYTE for *_, t in listed))
    trainer = _part(3, kind) + bytes([35 << 3 & 127 | 128, 35 >> 4, byte_fallback])
    return out + _part(2, trainer) + _part(3, _part(1, "identity") + _part(3, prefix) + _part(4, trims) + _part(5, 1))


SMALL = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
WORDS = [("ab", -1, 1), ("▁a", -2, 1), ("bc", -2, 1), ("abc", -3, 5), ("aba", -4, 1), ("▁▁", -5, 1), ("cab", -5, 1), ("a", -6, 1), ("b", -7, 1), ("▁", -8, 1)]


def check(model, texts):
    v, library = pieces.Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    ids, agrees = v.encode(texts, check=v.by_chunk)
    assert all(agrees)
    for t, got in zip(texts, ids, strict=True):
        want = library.encode(t)
        assert got.tolist() == want, t
        assert v.decode(np.array(want, dtype=np.int32)) == library.decode(want), t


def fuzz(alphabet, n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_public_vocabulary_equals_the_library(model):
    texts = fuzz(" \t\n▁ab the eéß漢字😀\x00​<s></s><0x0A>.,", 3000, 40, 1) + fuzz("abcdefgh the", 300, 400, 2)
    check(model, ["", " ", "   ", "▁", " a ", *texts, "no spaces here".replace(" ", "") * 50, " " * 1000, "é" * 5000])


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("trims", [0, 1])
@pytest.mark.parametrize("fallback", [False, True])
def test_small_vocabularies_equal_the_library(prefix, trims, fallback):
    listed = SMALL + ([(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else []) + [w for w in WORDS if w[2] == 1]
    check(small_model(listed, prefix=prefix, trims=trims), fuzz("abc  xé", 500, 12, 3))


def test_pieces_across_spaces_and_unused_pieces():
    # with a piece that holds an inner space a text is one chunk; an unused piece is split into its halves
    check(small_model([*SMALL, *WORDS, ("b▁a", -0.5, 1)]), fuzz("abc ", 500, 60, 4))
    check(small_model([*SMALL, *WORDS]), fuzz("abc ", 500, 12, 5))


def test_agendas_side_by_side_and_heaps_agree(model):
    v = pieces.Vocabulary(model)
    chunks = sorted({c for c in fuzz("▁theandinowhg éß漢.", 3000, pieces.SHORT, 6) if c})
    assert v._side_by_side(chunks) == [v._bytes_of(v.symbols(c)) for c in chunks]


def test_a_wrong_chunk_is_told(model):
    v = pieces.Vocabulary(model)
    v.costs = -v.costs  # merges the worst pair first
    texts = ["international understanding", "a"]
    ids, agrees = v.encode(texts, check=True)
    assert agrees == [ids[0].tolist() == v.library.encode(texts[0]), True] == [False, True]


def test_bytes_that_are_no_text(model):
    v = pieces.Vocabulary(model)
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.choice([*range(3, 259), 500, 600, 28705]) for _ in range(rng.randint(0, 8))]
        assert v.decode(np.array(ids, dtype=np.int32)) == v.library.decode(ids), ids


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(small_model([*SMALL, *WORDS], kind=1))
    with pytest.raises(ValueError):
        pieces.Vocabulary(small_model([*SMALL, *WORDS, ("x", 0, 4)]))


def test_edge_rows(spark, model, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNKS_KEPT", 3)  # started anew between texts
    rows = edge_rows("very long  text\n" * 60_000)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = pieces.encoded(docs(spark, rows), model).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(r[0], library.encode(r[1] or ""), r[1] or "", True) for r in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert pieces.encoded(docs(spark, []), model).count() == 0
    assert {r["agrees"] for r in pieces.encoded(docs(spark, rows[:3]), model, check=None).collect()} == {None}
    assert {r["agrees"] for r in pieces.encoded(docs(spark, rows), model, check="texts").collect()} == {True}


def test_query_equals_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert sorted(map(tuple, QUERIES["op12_sentencepiece"](spark, SF).collect())) == sorted(want)
