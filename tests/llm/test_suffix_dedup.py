import random

import numpy as np
import pytest

from trilect.llm import suffix_dedup as sd
from trilect.llm.suffix_sort import HashedText, sort_suffixes


def brute_force(rows):
    """(doc_id, n_bytes, spans, kept) of (doc_id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        if i is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(gone, np.uint8), [0]]).astype(int)))
        spans = [(int(a), int(e)) for a, e in zip(edges[::2], edges[1::2])]
        out.append((i, len(b), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def result(df):
    return [(r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()]


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", bytes(range(256))])
def test_suffixes_are_sorted(letters):
    rng = random.Random(len(letters))
    block = bytes(rng.choice(letters) for _ in range(400))
    data = block + bytes(rng.choice(letters) for _ in range(300)) + block[50:300] + b"a" * 200 + block
    starts = np.array(rng.sample(range(len(data) - 50), len(data) - 60))
    order, equal = sort_suffixes(np.frombuffer(data, np.uint8), starts, 50)
    windows = [data[k : k + 50] for k in order]
    assert windows == sorted(windows) and sorted(order) == sorted(starts)
    assert equal.tolist() == [False] + [a == b for a, b in zip(windows, windows[1:])]


def test_lying_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(HashedText, "hashes", lambda self, at, length: np.zeros(len(at), np.uint64))
    data = np.frombuffer(bytes(random.Random(1).choice(b"ab") for _ in range(600)) * 2, np.uint8)
    order, equal = sort_suffixes(data, np.arange(1100), 50)
    windows = [data[k : k + 50].tobytes() for k in order]
    assert windows == sorted(windows) and equal.tolist() == [False] + [a == b for a, b in zip(windows, windows[1:])]


def test_ties_are_sorted_by_bytes_alone(monkeypatch):
    """Suffixes that agree in an anchor, as those of a hot bucket do, need no hashed comparison of two."""

    def compared(self, at, length):
        raise AssertionError("two suffixes were compared by hashes")

    monkeypatch.setattr(HashedText, "hashes", compared)
    rng = random.Random(2)
    hot = bytes(rng.choice(b"abcd") for _ in range(30))
    data = b"".join(bytes(rng.choice(b"ab") for _ in range(25)) + hot for _ in range(300)) + b"\xff" * 60
    starts = np.arange(len(data) - 50)
    order, equal = sort_suffixes(np.frombuffer(data, np.uint8), starts, 50)
    windows = [data[k : k + 50] for k in order]
    assert windows == sorted(windows) and sorted(order) == starts.tolist()
    assert equal.tolist() == [False] + [a == b for a, b in zip(windows, windows[1:])]


def test_texts_hashed_together_have_their_own_anchors(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 500)
    rng = random.Random(3)
    rows = [(k, bytes(rng.choice(b"abc") for _ in range(rng.choice([50, 51, 80, 700])))) for k in range(40)]
    found = list(sd._anchored(rows))
    assert [r for r, _ in found] == rows
    assert all(np.array_equal(a, sd.anchors(np.frombuffer(t, np.uint8))) for (_, t), a in found)


def test_common_extension():
    text = np.frombuffer(b"abcabdabcabe" * 6, np.uint8)
    t = HashedText(text, 10)
    assert t.common(np.array([0, 0, 0]), np.array([3, 6, 12])).tolist() == [2, 5, 10]


def test_result_is_that_of_brute_force(make_docs):
    rng = random.Random(8)
    letter = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [letter(n) for n in (49, 50, 51, 60, 120, 400, 3000)]
    rows = []
    for k in range(60):
        parts = [letter(rng.randrange(80)) for _ in range(4)] + rng.sample(shared, rng.randrange(4))
        rng.shuffle(parts)
        rows.append((rng.randrange(10**6), "".join(parts)))
    rows += [(10**7 + k, "xy" * 60) for k in range(3)] + [(5, "z" * 200), (4, "z" * 120)]
    rows += [(2 * 10**7, shared[4] + shared[4][:60] + shared[5])]
    rng.shuffle(rows)
    assert sorted(result(sd.remove_repeats(make_docs(rows)))) == sorted(brute_force(rows))


def test_frequent_anchors_are_dealt_out_one_by_one(make_docs, monkeypatch):
    monkeypatch.setattr(sd, "FREQUENT", 5)
    rng = random.Random(9)
    letter = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, rare = letter(70), letter(90)
    rows = [(k, letter(rng.randrange(60)) + common[: rng.randrange(40, 71)] + letter(rng.randrange(60))) for k in range(40)]
    rows += [(50 + k, letter(20) + rare + letter(20) + common + rare[:60]) for k in range(3)]
    assert sorted(result(sd.remove_repeats(make_docs(rows)))) == sorted(brute_force(rows))


def test_real_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(result(sd.remove_repeats(documents))) == sorted(brute_force(rows))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(result(sd.remove_repeats(odd_docs)), key=repr) == sorted(brute_force(rows), key=repr)
    assert sd.remove_repeats(no_docs).count() == 0


def test_stage_rewrites_the_text(make_docs, odd_docs, no_docs):
    # The first byte of the last letter belongs to a repeat too; what is left of it is no letter.
    passage = "é" * 40
    out = sd.without_repeats(make_docs([(1, passage + "a"), (2, "b" + passage + "c"), (3, "€" + passage[:30] + "ö")]))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (passage + "a", 41), 2: ("bc", 2), 3: ("€", 1)}
    kept = sd.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes and kept.count() == odd_docs.count()
    assert sd.without_repeats(no_docs).count() == 0


def test_rows_without_an_id_of_their_own_are_judged(make_docs):
    rng = random.Random(10)
    p, q, own = ("".join(rng.choice("abcdefgh") for _ in range(80)) for _ in range(3))
    rows = [(None, "-" + p + "+"), (3, p), (7, "<" + q + ">"), (7, q), (None, own), (None, "=" + own)]
    out = sorted(((r.doc_id, r.text) for r in sd.without_repeats(make_docs(rows)).collect()), key=repr)
    assert (3, p) in out and (None, "-+") in out  # NULL comes after every id
    assert {t for i, t in out if i == 7} in ({"<" + q + ">", ""}, {q, "<>"})
    assert {t for i, t in out if i is None} - {"-+"} in ({own, "="}, {"", "=" + own})
    assert len(out) == len(rows)


def test_texts_with_other_columns_are_exchanged_once(spark):
    passage = "the same fifty bytes or more of a passage that is in both of them "
    docs = spark.createDataFrame([(1, "a " + passage, "en"), (2, "b " + passage, "de")], "doc_id bigint, text string, lang string")
    done = sd.remove_repeats(docs, carry=["lang"], as_text=True)
    assert [(r.doc_id, r._carried_0, r.kept) for r in sorted(done.collect())] == [(1, "en", "a " + passage), (2, "de", "b")]
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString()
