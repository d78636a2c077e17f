import itertools
import random

import numpy as np
import pytest

from trilect.llm import ngram_join as nj
from trilect.session import ensure_checkpoint_dir


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_force(rows, width, num, den):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5)])
def test_components_are_those_of_brute_force(make_docs, width, num, den):
    rng = random.Random(width)
    rows, doc = [], itertools.count(100)
    for size in (3, 6, 12, 20, 40, 90, 200, 700):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        chain = base
        for step in range(8):
            rows.append((next(doc), " ".join(edited(rng, base, rng.randrange(1 + size // 15)))))
            chain = edited(rng, chain, max(1, size // 90))  # each like the last, the ends unlike
            rows.append((next(doc), " ".join(chain)))
    rows += [(next(doc), rows[k][1].upper()) for k in range(0, 60, 7)]
    rng.shuffle(rows)
    got = nj.ngram_join(make_docs(rows), width, num, den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_force(rows, width, num, den))


def test_one_large_group_of_near_copies(make_docs, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 40)  # the group is compared block by block
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(8)))) for k in range(150)]
    got = nj.ngram_join(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_force(rows, 3, 9, 10))


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5), (19, 20)])
def test_similar_sets_share_a_signature(num, den):
    threshold, rng = nj.Threshold(num, den), np.random.default_rng(3)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64))
        most = int(threshold.differences(2 * len(a)))
        out, new = (int(rng.integers(0, most // 2 + 1)) for _ in range(2))
        b = np.unique(np.append(a[out:], rng.integers(0, 1 << 63, new, dtype=np.uint64)))
        common = len(np.intersect1d(a, b))
        if threshold.similar(common, len(a), len(b)) and (out or new):
            assert np.intersect1d(nj.signatures(a, threshold), nj.signatures(b, threshold)).size


def test_sketches_never_hide_a_similar_pair():
    rng = np.random.default_rng(4)
    for n in (5, 100, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.append(a[n // 10 :], rng.integers(0, 1 << 63, 3, dtype=np.uint64))
        sketches = [nj.sketch_of(x) for x in (a, b)]
        for size in (64, min(map(len, sketches))):
            bits = nj.folded(sketches, size)
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_join(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_force(rows, 3, 9, 10), key=repr)
    assert nj.ngram_join(no_docs).count() == 0


def test_one_row_of_each_component_stays_whatever_the_ids(make_docs, odd_docs, no_docs):
    rng = random.Random(6)
    texts = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "ABCDE"}
    near = lambda k: " ".join(edited(rng, texts[k], 1))
    a, b, c, d, e = (" ".join(texts[k]) for k in "ABCDE")
    rows = [(5, a), (5, b), (7, near("B")), (5, a)]  # one doc_id, unrelated texts
    rows += [(None, near("A")), (None, c), (None, c), (None, near("C")), (None, d), (9, near("D")), (None, e)]
    kept = [(r.doc_id, r.text.split()[0][0]) for r in nj.one_per_component(make_docs(rows)).collect()]
    assert sorted(kept, key=repr) == [(5, "A"), (5, "B"), (9, "D"), (None, "C"), (None, "E")]
    kept = nj.one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    # The row without an id is a copy of 4, and both texts of 10 stay.
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 10, 10, 11]
    assert nj.one_per_component(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    from trilect.llm.components import components

    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_signatures_travel_in_four_bytes(make_docs):
    docs = make_docs([(k, " ".join(f"w{k}x{j}" for j in range(80))) for k in range(3)]).select("doc_id", "text")
    for r in nj.packed_signatures(docs, 3, nj.Threshold(4, 5), 2).collect():
        assert len(r.signatures) == 4 * np.frombuffer(r.counts, np.uint32).sum()


def test_only_what_stays_is_left_on_disk(spark, make_docs, tmp_path):
    ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir().rpartition("/")[0]
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        kept = nj.one_per_component(make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")]))
        assert len(list(tmp_path.rglob("store-*"))) == 1 and not list(tmp_path.rglob("scratch-*"))
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    finally:
        spark.sparkContext.setCheckpointDir(before)
