import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilect.llm import class_lm as lm


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def base_scores(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c = collections.Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    total = sum(c.values())
    floor = math.log10(total + 0.5 * (len(c) + 1))
    out = []
    for (i, x), h in zip(rows, held):
        t = tokens(x)
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), total, sum(math.log10(c[w] + 0.5) - floor for w in t)))
    return out


def compare(df, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect()), key=repr)
    wanted = sorted(base_scores(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in wanted])


def test_base_scores(documents):
    scored = lm.score_held_out(documents).cache()
    compare(scored, [(r.doc_id, r.text) for r in documents.collect()])
    held = scored.filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert held.s > held.b  # classes tell more than frequencies


def test_rare_words_are_joined(documents, monkeypatch):
    monkeypatch.setattr(lm, "train", lambda texts, f=lm.train: f(texts, clustered=20, endings=8, classes=4, listed=50))
    compare(lm.score_held_out(documents), [(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd_docs, no_docs, make_docs):
    compare(lm.score_held_out(odd_docs), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert lm.score_held_out(no_docs).count() == 0
    untaught = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows = [(untaught, "only held out")]
    compare(lm.score_held_out(make_docs(rows)), rows)


def test_scores_are_probabilities(spark):
    """Over all continuations, unknown words as one, the model's probabilities add up to 1."""
    texts = spark.createDataFrame([("a b a c a b",), ("c c b a",), ("d",)], "text string")
    model = lm.train(texts, clustered=3, endings=2, classes=2, listed=100)
    assert np.allclose((10.0 ** model["steps"]).sum(1), 1)
    counts = {w: c for w, c in model["counts"].items() if w}
    symbols = lm.symbols_of(list(counts), model["clustered"], model["endings"])
    mass = collections.defaultdict(float)
    for c, k in zip(counts.values(), model["of"][symbols]):
        mass[k] += (c + 0.5) / 10 ** model["within"][k]
    for k, m in mass.items():
        assert m + 0.5 / 10 ** model["within"][k] == pytest.approx(1)


def information(of, left, right, n):
    width = of.max() + 1
    m = np.bincount(of[left] * width + of[right], n, width * width).reshape(width, width) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(m * np.log(m / np.outer(m.sum(1), m.sum(0))))


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    line = []
    for _ in range(4000):  # two kinds of words that take turns
        line += [int(rng.integers(0, 10)), int(rng.integers(10, 20))]
    line.append(20)
    pairs, n = np.unique(np.array(line[:-1]) * 21 + np.array(line[1:]), return_counts=True)
    left, right = np.divmod(pairs, 21)
    of = lm.exchange(left, right, n, 21, classes=2)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10]
    start = np.append(np.arange(20) % 2, 2)
    assert information(of, left, right, n) > information(start, left, right, n)


def test_no_single_move_is_better():
    rng = np.random.default_rng(2)
    pairs = np.arange(13 * 13)
    left, right = np.divmod(pairs, 13)
    n = rng.integers(1, 50, len(pairs))
    of = lm.exchange(left, right, n, 13, classes=3, sweeps=100)
    best = information(of, left, right, n)
    for w in range(12):
        for k in range(3):
            other = of.copy()
            other[w] = k
            assert information(other, left, right, n) <= best + 1e-9


def test_every_word_of_the_table_gets_a_class_by_its_own_counts(spark):
    """Words of two kinds take turns; all endings are one symbol, so only a word's neighbours tell its kind."""
    rng = np.random.default_rng(3)
    even, odd = ([f"{k}{n}x" for n in range(60)] for k in "ab")
    texts = []
    for _ in range(600):
        line = []
        for _ in range(10):
            line += [rng.choice(even + ["p"] * 180), rng.choice(odd + ["q"] * 180)]
        texts.append((" ".join(line),))
    model = lm.train(spark.createDataFrame(texts, "text string"), clustered=2, endings=1, classes=2, listed=10)
    of = {r.word: r.k for r in model["words"].collect()}
    assert len({of[w] for w in even} | {of["p"]}) == 1 and len({of[w] for w in odd} | {of["q"]}) == 1 and of["p"] != of["q"]
    assert of[""] == 2 and len(of) == 123
    scored = lm.score(spark.createDataFrame([(1, f"{even[0]} {odd[0]}"), (2, f"{odd[0]} {even[0]}")], "doc_id int, text string"), model)
    right, wrong = (r.score for r in scored.orderBy("doc_id").collect())
    assert right > wrong


def test_contexts_equal_a_count_of_all_neighbours(documents):
    """Words beside core words are counted by class in the map task, all others through joins; both tell the same."""
    texts = documents.select("text")
    lines = [tokens(r.text) for r in texts.collect()]
    frequent = [w for w, _ in collections.Counter(t for x in lines for t in x if t).most_common(30)]
    core, width = {w: k % 4 for k, w in enumerate(frequent)}, 5
    hash_of = {}

    def class_of(w):
        return width - 1 if w == b"" else core[w] if w in core else zlib.crc32(w) % 4

    want, matrix = collections.Counter(), np.zeros((width, width))
    for x in lines:
        for a, b in zip([b"", *x], x):
            matrix[class_of(a), class_of(b)] += 1
            if a and a not in core:
                want[a, class_of(b)] += 1
            if b and b not in core:
                want[b, class_of(a) + width] += 1
    words = sorted({w for x in lines for w in x if w and w not in core})
    hash_of = dict(zip(words, lm.hashed(words).tolist()))
    spark = documents.sparkSession
    free = spark.createDataFrame([(hash_of[w], class_of(w)) for w in words], "word bigint, k int")
    beside = lm.count_neighbours(texts, core, width).cache()
    met = lm.contexts(beside, free, width).cache()
    assert {(r.word, r.key): r.n for r in met.collect()} == {(hash_of[w], key): n for (w, key), n in want.items()}
    assert (lm.class_pairs(beside, met, width) == matrix).all()


def test_words_meet_their_first_classes_without_a_join(documents):
    """The classes by ending come with the counted neighbours; joining them tells the same."""
    texts = documents.select("text")
    counted = collections.Counter(w for r in texts.collect() for w in tokens(r.text) if w)
    core, width, first = {w: k % 4 for k, (w, _) in enumerate(counted.most_common(30))}, 5, np.array([2, 0, 3, 1, 1])
    words = [w for w in counted if w not in core]
    rows = [(h, int(first[lm.ending(w, len(first))])) for h, w in zip(lm.hashed(words).tolist(), words)]
    beside = lm.count_neighbours(texts, core, width, first).cache()
    free = documents.sparkSession.createDataFrame(rows, "word bigint, k int")
    plain, joined = lm.contexts(beside, None, width), lm.contexts(beside, free, width)
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    told = [sorted(map(tuple, x.select("word", "key", "k", "n", "core").collect())) for x in (plain, joined)]
    assert told[0] == told[1] and len(told[0]) > 100


def test_the_best_class_is_the_best_of_all():
    """Against taking a word out and putting it into every class, its neighbours' classes held."""
    rng = np.random.default_rng(5)
    width, words = 4, 40
    follows = rng.integers(50, 200, (width, width)).astype(float)
    home = rng.integers(0, width - 1, words)
    key, n, begins = [], [], [0]
    for _ in range(words):
        some = rng.choice(2 * width, rng.integers(1, 2 * width), replace=False)
        key += some.tolist()
        n += rng.integers(1, 12, len(some)).tolist()
        begins.append(len(key))
    key, n, begins = np.array(key), np.array(n, float), np.array(begins)
    got = lm.best_classes(home, begins, key, n, follows)
    for i in range(words):
        scores = []
        for k in range(width - 1):
            m = follows.copy()
            for c, x in zip(key[begins[i] : begins[i + 1]], n[begins[i] : begins[i + 1]]):
                for at, sign in ((home[i], -1), (k, 1)):
                    if c < width:
                        m[at, c] += sign * x
                    else:
                        m[c - width, at] += sign * x
            scores.append(lm.information(m))
        assert scores[got[i]] >= max(scores) - 1e-6 or got[i] == home[i]


def test_sweeps_go_on_until_nothing_moves(spark):
    rng = np.random.default_rng(6)
    even, odd = ([f"{k}{n}x" for n in range(30)] for k in "ab")
    texts = [(" ".join(f"{rng.choice(even + ['p'] * 60)} {rng.choice(odd + ['q'] * 60)}" for _ in range(10)),) for _ in range(200)]
    model = lm.train(spark.createDataFrame(texts, "text string"), clustered=2, endings=1, classes=2, listed=10, sweeps=None)
    of = {r.word: r.k for r in model["words"].collect()}
    assert {of[w] for w in even if w in of} == {of["p"]} and {of[w] for w in odd if w in of} == {of["q"]}
