"""Plans and partition shapes that have to hold at any size."""

import contextlib
import io
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trilect.operators import ordering as o
from trilect.operators import relational as rel
from trilect.plans import registry, score_queries, suite
from trilect.session import configure

HOT_ROWS, COLD_ROWS = 6000, 12000


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has key 7, some have none."""
    hot = spark.range(HOT_ROWS).select("id", F.lit(7).cast("bigint").alias("k"))
    cold = spark.range(HOT_ROWS, HOT_ROWS + COLD_ROWS).select("id", (F.col("id") % 997 + 10).alias("k"))
    none = spark.range(900_000, 900_500).select("id", F.lit(None).cast("bigint").alias("k"))
    return hot.unionByName(cold).unionByName(none).withColumn("v", F.xxhash64("id"))


def test_positions_equal_row_number(spark, skewed):
    got = o.positions(skewed, ["v", "id"], ["k"], "n")
    want = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).cast("bigint"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_positions_without_groups_are_dense(spark, skewed):
    got = o.positions(skewed, [F.col("v").desc(), "id"], name="n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    total = HOT_ROWS + COLD_ROWS + 500
    assert tuple(got) == (1, total, total)


def test_a_hot_group_is_spread_over_partitions(spark, skewed):
    # the fixture is far smaller than one partition of a cluster job
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = o.range_sorted(skewed, ["k", "v", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["n"] for r in staged.groupBy("_pid").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < (HOT_ROWS + COLD_ROWS) * 0.4


def test_lag_equals_the_window_function(spark, skewed):
    got = rel.lag_in_order(skewed, ["k"], ["v", "id"], "id", "before")
    want = skewed.withColumn("before", F.lag("id").over(Window.partitionBy("k").orderBy("v", "id")))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("counted", [False, True])
def test_lookup_join_equals_the_plain_join(spark, skewed, how, counted):
    right = spark.range(0, 500, 1).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = o.lookup_join(skewed, right, ["k"], how, counted=counted)
    want = skewed.join(right, ["k"], how)
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_lookup_join_without_a_broadcast_right(spark, skewed, monkeypatch):
    monkeypatch.setattr(o, "BROADCAST_ROWS", 3)
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert not o.small_enough(right, 3)
    got = o.lookup_join(skewed, right, ["k"], "left").agg(F.sum("w")).first()[0]
    assert got == skewed.join(right, "k", "left").agg(F.sum("w")).first()[0]


def test_wide_rows_are_not_small(spark):
    few = spark.range(100).select("id", F.lit("x" * 1000).alias("text"), F.array(F.lit("y")).alias("tags"))
    assert o.small_enough(few) and not o.small_enough(few, size=50_000) and not o.small_enough(few, rows=99)


def test_top_rows_are_cut_before_the_exchange(skewed):
    plan = plan_of(rel.top_per_key(skewed, ["k"], [F.col("v")], 2))
    assert plan.count("WindowGroupLimit") >= 2 and plan.index("WindowGroupLimit") < len(plan)
    assert "WindowGroupLimit" in plan_of(rel.rank_top(skewed, ["k"], [F.col("v")], 3))


def test_pages_use_a_top_k(skewed):
    plan = plan_of(rel.paginate(skewed, [F.col("v"), F.col("id")], 10, 10))
    assert "TakeOrderedAndProject" in plan


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    plan = plan_of(suite.QUERIES["m3_overdue_days_pg"](spark, data_dir))
    assert "EqualTo(o_orderstatus,O)" in plan and "LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan


def test_no_cartesian_products_or_python_workers(spark, data_dir):
    """Looks at the plans of all queries that build without running jobs of their own."""
    for name in ("e1_null_safe_avg_pg", "m1_month_bucket_semi_join_pg", "m4_year_month_having_pg", "h4_rollup_labelled_pg",
                 "C4_catalog_diff", "C10_reconcile_names", "T1_pin_time", "T7_feature_coverage", "P9_table_summary",
                 "E11_grade", "E20_pending", "P8_existing_value_digest", "R13_generate_rows", "EX1_sql_literal_oracle"):
        plan = plan_of(suite.QUERIES[name](spark, data_dir))
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_hierarchy_with_a_boss_of_a_third_of_all(spark):
    staff = spark.range(3000).select(
        "id", F.when(F.col("id") == 0, None).when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id") - 999).alias("boss")
    )
    loops = spark.createDataFrame([(5000, 5001), (5001, 5000)], "id bigint, boss bigint")
    got = rel.hierarchy(staff.unionByName(loops), "id", "boss")
    assert got.count() == 3000 and got.agg(F.max("depth")).first()[0] == 4
    assert rel.hierarchy(staff, "id", "boss", max_depth=1).count() == 1000


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """4,096 rows in a chain, a tail on a cycle and one below a missing parent."""
    rounds = []
    monkeypatch.setattr(rel, "cut_round", lambda df: rounds.append(1) or o.cut(df))
    parent = F.when(F.col("id") > 0, F.col("id") - 1)
    chain = spark.range(4096).select("id", parent.alias("up"))
    lost = spark.createDataFrame([(9000, 9001), (9001, 9000), (9002, 9001), (9003, 1_000_000), (9004, 9003)], "id bigint, up bigint")
    got = rel.hierarchy(chain.unionByName(lost), "id", "up", root_level=1)
    assert got.filter(F.col("depth") != F.col("id") + 1).isEmpty() and got.count() == 4096
    assert len(rounds) <= 14
    assert rel.hierarchy(chain, "id", "up", max_depth=100).count() == 101


def test_levels_take_one_exchange(spark):
    tables = spark.range(400).select(F.lit("d").alias("db"), F.concat(F.lit("t"), "id").alias("table_name"))
    edges = spark.range(1, 400).select(
        F.lit("d").alias("db"), F.concat(F.lit("t"), "id").alias("table_name"), F.concat(F.lit("t"), F.col("id") - 1).alias("ref_table")
    )
    from trilect.operators.catalog import fk_levels

    levels = fk_levels(tables, edges)
    assert levels._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert levels.filter(F.concat(F.lit("t"), "level") != F.col("table_name")).isEmpty() and levels.count() == 400


def test_query_names_are_plain():
    assert not [n for n in registry.QUERIES if n.startswith("op") or "pipeline" in n or "llm" in n]


def test_checkpoints_go_where_the_session_says(spark):
    o.range_sorted(spark.range(10), ["id"])
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = spark.sparkContext.getCheckpointDir()
    assert folder and (named is None or named in folder)


def test_many_top_rows_of_a_hot_key(spark, skewed):
    from trilect.operators.relational import top_per_key

    got = top_per_key(skewed, ["k"], [F.col("id").desc()], 2000)
    counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert counts[7] == 2000 and max(n for k, n in counts.items() if k not in (7, None)) < 20
    assert got.filter("k = 7").agg(F.min("id")).first()[0] == HOT_ROWS - 2000
    assert "WindowGroupLimit" not in got._jdf.queryExecution().executedPlan().toString()  # numbered over sorted ranges


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_large_lookup_reads_its_left_side_once(spark, skewed, how, tmp_path, monkeypatch):
    monkeypatch.setattr(o, "BROADCAST_ROWS", 10)
    skewed.write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    plan = o.lookup_join(left, right, ["k"], how, counted=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_a_job_leaves_nothing_behind(spark):
    from trilect.session import cut, ensure_checkpoint_dir, scratch, store

    ensure_checkpoint_dir(spark)
    base = os.path.dirname(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {f for f in os.listdir(base) if f.startswith("scratch-")}
    with scratch(spark):
        assert store(spark.range(10)).count() == cut(spark.range(10)).count() == 10
        assert spark.sparkContext.getCheckpointDir().split("/")[-2].startswith("scratch-")
    assert {f for f in os.listdir(base) if f.startswith("scratch-")} == before
    assert cut(spark.range(5)).count() == 5


def test_a_task_reads_little_of_a_shuffle_unless_the_session_says_more(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert spark.conf.get(key) == "8m"
    own = spark.newSession()
    own.conf.set(key, "1m")
    assert configure(own).conf.get(key) == "1m"


def test_mismatch_sample_joins_the_few_equal_queries_by_broadcast(spark, data_dir, monkeypatch):
    asked = []
    joined = score_queries.lookup_join
    monkeypatch.setattr(score_queries, "lookup_join", lambda *a, **k: asked.append(joined(*a, **k)) or asked[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        suite.QUERIES["E6_mismatch_sample"](spark, data_dir)
        assert ["BroadcastHashJoin" in plan_of(f) for f in asked] == [True]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
