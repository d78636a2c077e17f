import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece

from trilect.llm.pieces import SIDE_BY_SIDE, Pieces, encode_batch, encode_pieces
from trilect.llm.queries import tokenizer

ODD = [
    "", " ", "  ", "   a", "a ", "a  ", "a  b", " a b ", "▁x", "x▁▁ y", "é😀\x00q", "a\n\n  b\t", "aaaa" * 3000, " \n ",
    "日本語 テキスト", "▁", "ﬁ Ａ ½", "word,word.word!" * 20, "<s> </s> <unk> <0x41>", "\x01\x02 \x7f", "x" * SIDE_BY_SIDE, "été" * 40,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer())


def test_odd_texts(library):
    ids, agrees = encode_batch(Pieces(tokenizer()), pa.array([*ODD, None]))
    assert ids.to_pylist() == [*map(library.encode, ODD), []] and all(agrees.to_pylist())


def test_random_texts(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab eé  thn.,\n▁日😀") for _ in range(rng.randrange(300))) for _ in range(300)]
    ids, agrees = encode_batch(Pieces(tokenizer()), pa.array(texts))
    assert ids.to_pylist() == [library.encode(t) for t in texts] and all(agrees.to_pylist())


def test_heap_and_arrays_agree():
    pieces, rng = Pieces(tokenizer()), random.Random(3)
    words = ["▁" + "".join(rng.choice("theranoisd") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    flat, begins = pieces.encode_all(words)
    assert [flat[a:b].tolist() for a, b in zip(begins, begins[1:])] == [pieces.segment(w) for w in words]


def test_a_disagreement_is_reported(monkeypatch):
    pieces = Pieces(tokenizer())
    pieces.pair_costs = -pieces.pair_costs  # worst pair first
    _, agrees = encode_batch(pieces, pa.array(["", "hello", "a"]))
    assert agrees.to_pylist() == [True, False, True]


def test_documents(documents, library):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in encode_pieces(documents, tokenizer()).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.agrees and r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
    for r in encode_pieces(documents, tokenizer(), digests=True).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, library):
    got = sorted(((r.doc_id, r.ids) for r in encode_pieces(odd_docs, tokenizer()).collect()), key=repr)
    assert got == sorted(((r.doc_id, library.encode(r.text or "")) for r in odd_docs.collect()), key=repr)
    assert encode_pieces(no_docs, tokenizer()).count() == 0
