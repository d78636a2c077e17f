"""Profiling and sampling jobs."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilect.functions.columns import as_column
from trilect.operators.ordering import checked_broadcast, lookup_join, positions
from trilect.operators.ranking import NATIVE_ROWS, numbered_top
from trilect.operators.relational import top_per_key
from trilect.session import cut
from trilect.sources.tables import explode_requirements

# The names that mark a column as a row's human-readable key.
KEY_NAMES = ["name", "shortname", "short_name", "title", "fullname", "full_name"]
# Order of knowledge-base item types in a sample.
TYPE_PRIORITY = {"function": 0, "keyword": 1, "operator": 2, "type": 3}
OTHER_PRIORITY = 9
# Seed offset of each benchmark split.
SPLIT_SEED_OFFSET = {"train": 0, "dev": 1000, "test": 2000}


def hash_order(key: str | Column, seed: int) -> Column:
    """A repeatable shuffle order: md5 of key and seed."""
    return F.md5(F.concat(as_column(key).cast("string"), F.lit(f":{seed}")))


def hash_int(text: Column) -> Column:
    """The first 32 bits of md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_long(text: Column) -> Column:
    """The first 60 bits of md5 as a non-negative bigint, for choices among very many."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def bank_round(x: Column) -> Column:
    """Half-even rounding to a whole number."""
    return F.bround(x, 0).cast("int")


def sample_rows(df: DataFrame, order: Sequence[Column], n: int = 5, width: int = 50) -> DataFrame:
    """The first ``n`` rows as display text: NULL spelled out, long values cut to ``width`` plus dots."""

    def shown(c: str) -> Column:
        text = F.col(c).cast("string")
        return (
            F.when(text.isNull(), F.lit("NULL"))
            .when(F.char_length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("...")))
            .otherwise(text)
            .alias(c)
        )

    return df.orderBy(*order).limit(n).select(*[shown(c) for c in df.columns])


def minmax_profile(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(column_name, data_type, min_value, max_value) per column, one scan; all-NULL columns are left out.

    ``columns`` maps the profiled columns to their declared types; see
    ``catalog.profiled_columns`` for the choice of columns.
    """
    bounds = df.agg(
        *[F.min(c).cast("string").alias(f"min_{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("string").alias(f"max_{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(t).alias("data_type"),
                F.col(f"min_{i}").alias("min_value"),
                F.col(f"max_{i}").alias("max_value"),
            )
            for i, (c, t) in enumerate(columns.items())
        ]
    )
    return bounds.select(F.inline(rows)).filter(F.col("min_value").isNotNull())


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Proportional sample: max(1, round(size / total * n)) rows per stratum, at most ``n`` in all.

    A stratum's quota never exceeds ``n``, so rows past ``n`` in hash order go before the exchange.
    """
    total = max(df.count(), 1)
    quota = (
        df.groupBy(F.col(stratum).alias("_stratum"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_stratum", F.greatest(F.lit(1), bank_round(F.col("_size") / total * n)).alias("_quota"))
    )
    first = _ranked(df, stratum, key, max(n, 1), seed)
    taken = first.join(quota, first[stratum].eqNullSafe(quota["_stratum"])).filter(F.col("_rank") <= F.col("_quota"))
    return taken.orderBy("_hash", key).limit(n).select(*df.columns)


def _ranked(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of every stratum in hash order, with their ``_hash`` and ``_rank``."""
    hashed, order = df.withColumn("_hash", hash_order(key, seed)), ["_hash", key]
    if n > NATIVE_ROWS:
        return numbered_top(hashed, [stratum], order, n, "_rank")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return hashed.withColumn("_rank", rank).filter(F.col("_rank") <= n)


def priority_of(kind: str | Column, priority: dict[str, int] | None = None) -> Column:
    pairs = TYPE_PRIORITY if priority is None else priority
    kind = as_column(kind)
    out = F.lit(OTHER_PRIORITY)
    for name, place in pairs.items():
        out = F.when(kind == name, F.lit(place)).otherwise(out)
    return out


def simple_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(n)


def quotas(weights: dict[str, float], base: int) -> dict[str, int]:
    """Rounds per level: max(1, round(base * weight / smallest weight)), half-even."""
    smallest = min(weights.values())
    return {level: max(1, round(base * w / smallest)) for level, w in weights.items()}


def weighted_quota_sample(
    df: DataFrame, stratum: str, key: str, weights: dict[str, float], base: int, seed: int
) -> DataFrame:
    """Per level of ``stratum`` its quota of rows in hash order."""
    wanted = quotas(weights, base)
    ranked = _ranked(df.filter(F.col(stratum).isin(list(wanted))), stratum, key, max(wanted.values()), seed)
    allowed = F.lit(0)
    for level, count in wanted.items():
        allowed = F.when(F.col(stratum) == level, F.lit(count)).otherwise(allowed)
    return ranked.filter(F.col("_rank") <= allowed).select(*df.columns)


def coverage_allocate(
    items: DataFrame, item: str, targets: DataFrame, target: str, per_target: int, min_cover: int, seed: int
) -> DataFrame:
    """Give every target ``per_target`` distinct items so that every item is used ``min_cover`` times or more.

    Both sides are put in hash order; slot k of the target at place t takes the item
    at place (t * per_target + k) modulo the item count, so uses differ by one at most.
    """
    n_items, n_targets = items.count(), targets.count()
    if n_targets * per_target < n_items * min_cover:
        raise ValueError(f"{n_targets} targets x {per_target} cannot cover {n_items} items {min_cover} times")
    if per_target > n_items:
        raise ValueError(f"{per_target} distinct items per target asked, {n_items} given")
    placed_items = positions(items.select(item), [hash_order(item, seed), F.col(item)], name="_i")
    placed_targets = positions(targets.select(target), [hash_order(target, seed), F.col(target)], name="_t")
    slots = placed_targets.select(
        target, F.explode(F.sequence(F.lit(0), F.lit(per_target - 1))).alias("_k"), F.col("_t")
    ).select(
        target,
        (F.pmod((F.col("_t") - 1) * F.lit(per_target) + F.col("_k"), F.lit(n_items)) + 1).alias("_i"),
    )
    return slots.join(checked_broadcast(cut(placed_items)), "_i").select(target, item)


def discover(assigned: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Assigned keys with ``status`` present or missing."""
    have = available.select(key).distinct().withColumn("_have", F.lit(True))
    return (
        assigned.select(key)
        .distinct()
        .join(have, key, "left")
        .select(key, F.when(F.col("_have"), F.lit("present")).otherwise(F.lit("missing")).alias("status"))
    )


def existing_value_digest(df: DataFrame, pk: str, fields: Sequence[str], show: int = 30) -> DataFrame:
    """(field, rows, max_id, next_id, n_distinct, shown) for each of the fields.

    The distinct values are counted in parallel; only the first ``show`` are listed.
    """
    long = df.select(
        pk, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(f).alias("v")) for f in fields])).alias("p")
    ).select(pk, "p.*")
    heads = long.groupBy("field").agg(F.count(F.lit(1)).alias("row_count"), F.max(pk).alias("max_id"))
    distinct = long.filter(F.col("v") != "").select("field", "v").distinct()
    counted = distinct.groupBy("field").agg(F.count(F.lit(1)).alias("n_distinct"))
    listed = (
        top_per_key(distinct, ["field"], [F.col("v")], show)
        .groupBy("field")
        .agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("shown"))
    )
    return heads.join(counted, "field").join(listed, "field").select(
        "field", "row_count", "max_id", (F.col("max_id") + 1).alias("next_id"), "n_distinct", "shown"
    )


def requirements_for(assigned: DataFrame, differences: DataFrame) -> DataFrame:
    """Bridge (db, diff_id) with the listed requirements of each difference, one row per requirement.

    The lists are exploded after the lookup: a difference that most databases share
    is looked up, and its requirements are not multiplied before the join.
    """
    details = differences.withColumnRenamed("id", "diff_id")
    found = lookup_join(assigned, details, ["diff_id"], counted=True).withColumnRenamed("diff_id", "id")
    return explode_requirements(found, ["db"]).withColumnRenamed("id", "diff_id")
