import itertools
import random

import numpy as np
import pytest

from trilect.llm.mixing import SHARE, WEIGHTS, fit, mix_sources, mixed, targets


def shares(sizes):
    """Targets of sources, in their order, by handing out what is left again and again."""
    limit = [2 * s for s in sizes]
    weight = [WEIGHTS[k % 3] for k in range(len(sizes))]
    budget, held = SHARE * sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in held]
        rest = budget - sum(limit[k] for k in held)
        got = {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        over = {k for k in free if got[k] > limit[k]}
        if not over:
            return [float(limit[k]) if k in held else got[k] for k in range(len(sizes))]
        held |= over


@pytest.mark.parametrize("seed", range(30))
def test_fit_reaches_the_nearest_sum(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 30), rng.randrange(1, 5)))
    counts = [rng.randrange(1, 4) for _ in lengths]
    size = sum(a * b for a, b in zip(lengths, counts))
    target = rng.uniform(0, 2.4) * size
    base, more = fit(np.array(lengths), np.array(counts), target)
    assert base in (0, 1, 2) and all(0 <= m <= c for m, c in zip(more, counts)) and (base < 2 or not more.any())
    taken = base * size + sum(int(m) * x for m, x in zip(more, lengths))
    assert taken <= max(1, round(min(target, 2 * size)))
    # What the proportional share leaves is solved exactly.
    rest = min(round(target), 2 * size) - base * size
    floor = [rest * c // size for c in counts] if base < 2 else counts
    left = rest - sum(f * x for f, x in zip(floor, lengths))
    sums = {sum(n * x for n, x in zip(pick, lengths)) for pick in itertools.product(*[range(c - f + 1) for c, f in zip(counts, floor)])}
    best = max((s for s in sums if s <= left), default=0)
    assert base == 2 or taken == min(round(target), 2 * size) - left + best


def test_fit_with_budgets_past_the_exact_part():
    lengths, counts = np.array([3, 500, 7919, 90001]), np.array([10**6, 10**5, 10**4, 10**3])
    size = int((lengths * counts).sum())
    for share in (0.1, 0.9, 1.3, 1.99):
        base, more = fit(lengths, counts, share * size)
        assert abs(base * size + int((more * lengths).sum()) - share * size) <= 2


def test_lengths_of_one_document_give_a_seeded_share():
    lengths = np.arange(1, 4001)
    size = int(lengths.sum())
    base, more = fit(lengths, np.ones(4000, np.int64), 0.5 * size)
    assert base == 0 and set(more) == {0, 1} and abs(int((more * lengths).sum()) - size // 2) <= 1
    for low in range(0, 4000, 500):  # every band of lengths, not the longest only
        assert 200 <= more[low : low + 500].sum() <= 300
    other = fit(lengths, np.ones(4000, np.int64), 0.5 * size, seed=1)[1]
    assert (other != more).any() and (fit(lengths, np.ones(4000, np.int64), 0.5 * size)[1] == more).all()


@pytest.mark.parametrize("n", [300, 500, 600, 2000])
def test_the_draw_is_seeded_at_every_size(n):
    lengths = np.arange(1, n + 1)
    half = int(lengths.sum()) // 2
    base, more = fit(lengths, np.ones(n, np.int64), half)
    assert base == 0 and int((more * lengths).sum()) == half
    for fifth in np.array_split(more, 5):
        assert abs(fifth.sum() - n / 10) <= 0.15 * n / 10


def test_the_draw_gives_back_for_an_exact_sum():
    lengths, counts = np.array([2, 7, 40, 90]), np.array([1, 1, 30, 30])
    size = int((lengths * counts).sum())
    for target in range(1, size, 97):
        taken = int((fit(lengths, counts, target)[1] * lengths).sum())
        floor = target * counts // size
        free = [range(int(c - f) + 1) for c, f in zip(counts, floor)]
        sums = {int((floor * lengths).sum()) + sum(n * x for n, x in zip(pick, lengths.tolist())) for pick in itertools.product(*free)}
        assert taken == max(s for s in sums if s <= target)


def test_long_documents_are_fitted_in_time():
    rng = np.random.default_rng(0)
    lengths = np.unique(np.append(rng.integers(20, 6000, 4000), [1_000_000, 700_001]))
    counts = rng.integers(1, 60, len(lengths))
    size = int((lengths * counts).sum())
    for share in (0.31, 1.5):
        base, more = fit(lengths, counts, share * size)
        assert (more <= counts).all() and abs(base * size + int((more * lengths).sum()) - share * size) <= 1


def test_targets(spark):
    sizes = {"b": 100, "B": 4000, "é": 300, "": 50, None: 900, "a": 0, "z": 70}
    order = ["", "B", "a", "b", "z", "é", None]
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert [got[s] for s in order] == pytest.approx(shares([sizes[s] for s in order]))


def check(rows):
    by = {}
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        by.setdefault((r.source, r.source_size, r.target), []).append(r)
    for (_, size, target), own in by.items():
        assert size == sum(r["size"] for r in own)
        assert abs(target - sum(r.taken for r in own)) <= max(r["size"] for r in own)
    return by


def test_documents(documents):
    rows = mix_sources(documents).collect()
    by = check(rows)
    order = sorted(by, key=lambda k: (k[0] is None, (k[0] or "").encode()))
    assert [k[2] for k in order] == pytest.approx(shares([k[1] for k in order]))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(documents).collect()))


def test_odd_rows(odd_docs, no_docs):
    rows = mix_sources(odd_docs).collect()
    check(rows)
    sizes = {r.doc_id: r["size"] for r in rows}
    assert len(rows) == odd_docs.count() and sizes[1] == sizes[2] == sizes[3] == 0 and sizes[6] == 30_000
    assert mix_sources(no_docs).count() == 0


def test_stage_takes_rows_as_often_as_the_mix(odd_docs, no_docs, documents):
    for docs in (odd_docs, documents):
        out = mixed(docs)
        assert out.columns == docs.columns
        wanted = {}
        for r in mix_sources(docs).collect():
            wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.copies
        got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        assert got == {k: n for k, n in wanted.items() if n}
    assert mixed(no_docs).count() == 0
