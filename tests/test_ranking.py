"""First rows per key and deep pages, against sorting everything."""

import random

import pytest
from pyspark.sql import functions as F

from trilect.operators import profile, ranking
from trilect.operators import relational as rel

N = 300_000


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows have one key, a few have none."""
    key = F.when(F.col("id") % 3 < 2, 7).when(F.col("id") % 3000 == 2, None).otherwise(F.col("id") % 97)
    value = F.when(F.col("id") % 11 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)))
    return spark.range(N).select(key.cast("int").alias("k"), value.alias("v"), "id").cache()


def smallest(v):
    return (v is not None, v or 0)


@pytest.mark.parametrize("order", [["v", "id"], ["v DESC", "id"], ["id DESC"], ["column", "id"]])
@pytest.mark.parametrize("n", [2000, 100_000])
def test_first_rows_of_a_hot_key(spark, hot, order, n):
    columns = [F.col("v").desc() if c == "column" else c for c in order]
    got = rel.top_per_key(hot, ["k"], columns, n).filter("k = 7").select("id").collect()
    rows = [(r.v, r.id) for r in hot.filter("k = 7").collect()]
    rows.sort(key=lambda r: r[1])
    if order == ["id DESC"]:
        rows.reverse()
    elif order == ["v", "id"]:
        rows.sort(key=lambda r: smallest(r[0]))
    else:
        rows.sort(key=lambda r: smallest(r[0]), reverse=True)  # stable, so ids still ascend
    assert {r.id for r in got} == {i for _, i in rows[:n]} and len(got) == n


def test_every_key_keeps_its_rows(hot):
    counts = {r.k: r["count"] for r in rel.top_per_key(hot, ["k"], ["v", "id"], 2000).groupBy("k").count().collect()}
    sizes = {r.k: r["count"] for r in hot.groupBy("k").count().collect()}
    assert counts == {k: min(n, 2000) for k, n in sizes.items()}


def test_few_rows_are_dealt_out(hot):
    """The sample's cut-off leaves little more than the rows asked for."""
    limits = ranking.cut_offs(hot, ["k"], ["v", "id"], 2000)
    assert [r.k for r in limits.collect()] == [7]
    limit = limits.first()["_limit"]
    left = [r for r in hot.filter("k = 7").collect() if (smallest(r.v), r.id) <= (smallest(limit[0]), limit[1])]
    assert 2000 <= len(left) < 3500


def test_a_cut_off_that_comes_too_early_is_noticed(hot, monkeypatch):
    monkeypatch.setattr(ranking, "CUT_RANK", 20)
    counts = {r.k: r["count"] for r in rel.top_per_key(hot, ["k"], ["v", "id"], 2000).groupBy("k").count().collect()}
    assert counts[7] == 2000 and counts[1] == min(2000, hot.filter("k = 1").count())


def test_large_samples_are_what_they_were(hot):
    """A quota past Spark's own limit picks the rows that one sort would."""
    got = {r.id for r in profile.weighted_quota_sample(hot.filter("k IS NOT NULL").withColumn("k", F.col("k").cast("string")), "k", "id", {"7": 3.0, "5": 1.0}, 1500, 3).collect()}
    want = set()
    for level, quota in profile.quotas({"7": 3.0, "5": 1.0}, 1500).items():
        rows = hot.filter(F.col("k") == int(level)).orderBy(profile.hash_order("id", 3), "id").limit(quota)
        want |= {r.id for r in rows.collect()}
    assert got == want
    sample = profile.stratified_sample(hot, "k", "id", 5000, 3)
    assert 4900 < sample.count() <= 5000  # quotas are rounded


@pytest.mark.parametrize("offset, n", [(0, 20_000), (150_000, 7), (N - 3, 10), (N, 5), (99_990, 30_000)])
def test_deep_pages(hot, offset, n):
    got = [r.id for r in rel.paginate(hot, [F.col("v").desc(), F.col("id")], offset, n).collect()]
    rows = sorted(((r.v, r.id) for r in hot.collect()), key=lambda r: r[1])
    rows.sort(key=lambda r: smallest(r[0]), reverse=True)
    assert got == [i for _, i in rows[offset : offset + n]]


def test_a_page_reads_the_ranges_that_hold_it(spark, hot, monkeypatch):
    """The rows that are sorted for the page are few, wherever it lies."""
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        page = rel.paginate(hot, [F.col("id")], 200_000, 10)
        plan = page._jdf.queryExecution().optimizedPlan().toString()
        assert "_mid" in plan and "Filter" in plan
        low, high = (int(x) for x in __import__("re").findall(r"_mid#\d+L? (?:>=|<=) (\d+)", plan)[:2])
        assert (high >> 33) - (low >> 33) <= 1
        assert [r.id for r in page.collect()] == list(range(200_000, 200_010))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_small_random_tables(spark, monkeypatch):
    monkeypatch.setattr(rel, "NATIVE_ROWS", 0)
    monkeypatch.setattr(ranking, "SAMPLED", 2)
    monkeypatch.setattr(ranking, "CUT_RANK", 2)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.5, float("inf")]), k) for k in range(60)]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    for n in (1, 3, 25):
        got = {r.id for r in rel.top_per_key(df, ["k"], ["v DESC", "id DESC"], n).collect()}
        want = set()
        for key in ("a", "b", None):
            mine = sorted((r for r in rows if r[0] == key), key=lambda r: (smallest(r[1]), r[2]), reverse=True)
            want |= {r[2] for r in mine[:n]}
        assert got == want
