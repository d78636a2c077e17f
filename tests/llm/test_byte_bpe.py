import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from trilect.llm import byte_bpe
from trilect.llm.byte_bpe import Ranks, decode_bytes, encode_bytes, merged, newer_characters
from trilect.llm.queries import tokenizer

PATH, PATTERN = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [
    "", " ", "   ", "a ", "  b", "'re'll we've", "a\n\n  b\t", "aaaa" * 3000, "é" * 999, "日本語 テキスト", "\x00\x01\x1c", "<|endoftext|>",
    "ﬁ Ａ ½ ٣", "word,word.word!" * 20, "!" * 500, " " * 700 + "x", "՘a ꟎1 \U00011de0", "😀" * 40,
]


@pytest.fixture(scope="module")
def ranks():
    return Ranks(PATH, PATTERN, newer_characters())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.rank_of, special_tokens={})


def texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice("abeé  thn.,\n'rels日😀1٣՘") for _ in range(rng.randrange(size))) for _ in range(n)]


def test_texts(ranks, library):
    given = ODD + texts(1, 500, 200)
    ids = ranks.encode_all(given)
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in given]
    assert ranks.decode_all(ids).to_pylist() == [t.encode() for t in given]


def test_long_texts_are_cut_without_a_trace(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CUT_CHARS", 17)
    given = [*texts(2, 300, 400), "a" * 300 + "'re b", "x'r" * 40, ""]
    assert ranks.encode_all(given).to_pylist() == [library.encode_ordinary(t) for t in given]


def test_joining_is_what_merging_the_whole_gives(ranks):
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choice(b"aabethn r\xc3\xa9") for _ in range(rng.randrange(2, 60)))
        parts = merged([bytes([b]) for b in data], ranks.rank_of)
        whole = tuple(ranks.rank_of[p] for p in parts)
        assert ranks.encode(data) == whole
        k = rng.randrange(len(data) + 1)
        assert ranks.join(ranks.encode(data[:k]), ranks.encode(data[k:])) == whole


def test_halves_and_arrays_agree(ranks):
    strings = [t.encode()[:60] for t in texts(4, 400, 60)]
    flat, counts = ranks.encode_side_by_side(strings)
    assert [tuple(x.tolist()) for x in np.split(flat, np.cumsum(counts)[:-1])] == [ranks.encode(s) for s in strings]


def test_a_window_grows_where_merges_run_on(tmp_path):
    """Tokens a, aa and aaaa: a boundary inside a run changes all tokens right of it."""
    path = tmp_path / "own.tiktoken"
    tokens = [b"a", b"b", b"aa", b"aaaa", b"ab"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    small = Ranks(str(path), r"\w+")
    assert small.join(small.encode(b"aaa"), small.encode(b"aaaaab")) == small.encode(b"a" * 8 + b"b") == (3, 3, 1)
    assert small.encode(b"a" * 7 + b"b") == (3, 2, 4)


def test_documents(documents, library):
    given = {r.doc_id: r.text for r in documents.collect()}
    for r in encode_bytes(documents, PATH, PATTERN, digests=True).collect():
        ids = library.encode_ordinary(given[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(given[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, library):
    rows = encode_bytes(odd_docs, PATH, PATTERN)
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in rows.collect()), key=repr)
    given = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert got == sorted(((i, library.encode_ordinary(t), t.encode()) for i, t in given), key=repr)
    again = decode_bytes(rows.select("doc_id", "ids"), PATH, PATTERN)
    assert sorted((bytes(r.decoded) for r in again.collect())) == sorted(t.encode() for _, t in given)
    assert encode_bytes(no_docs, PATH, PATTERN, digests=True).count() == 0


def test_null_ids_give_no_bytes(ranks):
    assert ranks.decode_all(pa.array([None, [], [0]], pa.list_(pa.int32()))).to_pylist() == [b"", b"", ranks.bytes_of[0]]
