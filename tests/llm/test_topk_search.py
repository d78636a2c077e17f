import math
import random

import pytest
from pyspark.sql import functions as F

from trilect.llm.topk_search import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank string, query_id string, v string"


def brute_force(rows, k):
    ok = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % 5 == 0}:
        best = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q))[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, "", "", "") for i, v in rows], SCHEMA)


def result(df, **how):
    got = top_k(df, F.col("vec_id") % 5 == 0, **how)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


@pytest.mark.parametrize("blocks", [(4096, 512), (7, 3)])
def test_brute_force(spark, blocks):
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(6)]) for k in range(120)]
    rows += [(200 + k, rows[3][1]) for k in range(20)]  # ties
    got = result(frame(spark, rows), candidate_block=blocks[0], query_block=blocks[1])
    single = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").collect()
    assert got == brute_force([(r.vec_id, r.embedding) for r in single], 5)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (10, None), (15, [None, 1.0]), (20, [math.nan]), (25, [math.inf, 0.0]),
        (30, []), (35, [0.5]), (None, [1.0, 1.0]), (1, [3.0, -1.0, 4.0]), (2, [0.0, 0.0]), (-5, [1.0] * 5000),
    ]
    assert result(frame(spark, rows)) == brute_force(rows, 5)
    assert result(frame(spark, rows), k=1) == brute_force(rows, 1)
    assert result(frame(spark, [])) == [] and result(frame(spark, [(0, [1.0])])) == [] and result(frame(spark, [(1, [1.0])])) == []


def test_scores_past_a_long_raise(spark):
    with pytest.raises(Exception, match="too large"):
        result(frame(spark, [(0, [1e13, 1.0]), (1, [1e13, 2.0])]))


@pytest.mark.parametrize("blocks", [(4096, 512), (1, 1)])
@pytest.mark.parametrize(
    "rows",
    [
        [(0, [4e13, 0.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0])],
        [(0, [1e7, 0.0]), (1, [0.0, 1e7]), (2, [3.0, 4.0]), (4, [0.0, 1e10]), (6, [0.25, -1e10])],
        [(0, [1.0, 0.5]), (1, [-1e300, 0.0]), (2, [2.0, 1e12]), (3, [3.0, -1e13])],
    ],
)
def test_finite_components_of_any_size_take_part(spark, rows, blocks):
    """A score that a long can't hold only matters where it would be returned."""
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 5 == 0, k=2, candidate_block=blocks[0], query_block=blocks[1]).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_force(rows, 2)
