"""Relational operators of the three dialects that Spark SQL does not spell."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilect.functions.columns import as_column
from trilect.operators.ordering import (
    checked_broadcast,
    lookup_join,
    null_safe_join,
    positions,
    range_sorted,
)
from trilect.operators.ranking import NATIVE_ROWS, deep_page, numbered_top, ordering
from trilect.session import cut, cut_round

#: So many rows one task may hold for a page.
TOP_ROWS = 10_000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key; ``order`` has columns, names, or names with `` DESC``.

    A literal bound on the row number lets Spark keep ``n`` rows per key and map
    task before the exchange, so a hot key is cut down where it lies. Spark does so up to
    ``NATIVE_ROWS``; beyond, see ``ranking.numbered_top``.
    """
    if n > NATIVE_ROWS:
        return numbered_top(df, keys, order, n, "_rank").drop("_rank")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``SELECT DISTINCT ON (keys) ... ORDER BY keys, order``."""
    return top_per_key(df, keys, order, 1)


def rank_top(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """Rows whose RANK() within ``keys`` is at most ``n``; pruned before the exchange like ``top_per_key``."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def paginate(df: DataFrame, order: Sequence[Column], offset: int, n: int) -> DataFrame:
    """``LIMIT off, n`` / ``LIMIT n OFFSET off``; ``order`` needs a unique last key to be repeatable.

    Past ``TOP_ROWS`` rows the page is taken from the ranges that hold it.
    """
    if offset + n > TOP_ROWS:
        return deep_page(df, order, offset, n)
    return df.orderBy(*order).offset(offset).limit(n)


def rownum_before_order(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """``WHERE ROWNUM <= n ORDER BY ..``: n arbitrary rows, then sorted. Not repeatable, as in the dialect."""
    return df.limit(n).orderBy(*order)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "row_number"
) -> DataFrame:
    """ROW_NUMBER() over whole groups of any size."""
    return positions(df, order, keys, name)


def lag_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, name: str
) -> DataFrame:
    """``LAG(value) OVER (PARTITION BY keys ORDER BY order)`` for keys with any number of rows.

    Rows are range-sorted on (keys, order), so a hot key is spread over partitions.
    Inside a partition LAG is a window; a summary with one row per partition and key
    carries the last value across.
    """
    staged = range_sorted(df, [*keys, *order])
    last = staged.groupBy("_pid", *keys).agg(F.max_by(F.struct(value), "_mid").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_pid")
    carried = cut(last.select("_pid", *keys, F.lag(F.col(f"_last.{value}")).over(earlier).alias("_carry")))
    here = Window.partitionBy("_pid", *keys).orderBy("_mid")
    lagged = staged.withColumn("_nth", F.row_number().over(here)).withColumn("_lag", F.lag(value).over(here))
    joined = null_safe_join(lagged, checked_broadcast(carried), ["_pid", *keys], "left")
    return joined.select(*df.columns, F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(F.col("_lag")).alias(name))


def hierarchy(
    df: DataFrame, id_col: str, parent_col: str, max_depth: int | None = None, root_level: int = 0, name: str = "depth"
) -> DataFrame:
    """``WITH RECURSIVE`` from the rows without a parent (depth 0), or ``CONNECT BY`` (LEVEL 1: ``root_level=1``).

    ``id_col`` is unique. Every row points to an ancestor and knows how far it is; each round a
    row goes on to where its ancestor points, so a depth of d takes about log2(d) rounds. A row
    on a cycle, or below a missing parent, never reaches a root and is left out, as in the
    dialects. Only ids go round; the rows are joined once at the end.
    """
    ids = cut(df.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_above")))
    done = [ids.filter("_above IS NULL").select("_id", F.lit(root_level).alias("_depth"))]
    todo = ids.filter("_above IS NOT NULL").withColumn("_far", F.lit(1))
    reached = 1
    while (max_depth is None or reached <= max_depth) and not todo.isEmpty():
        placed = reduce(DataFrame.unionByName, done).select(
            F.col("_id").alias("_above"), F.lit(None).alias("_next"), F.col("_depth").alias("_add"), F.lit(True).alias("_root")
        )
        moving = todo.select(
            F.col("_id").alias("_above"), F.col("_above").alias("_next"), F.col("_far").alias("_add"), F.lit(False).alias("_root")
        )
        stepped = cut_round(
            lookup_join(todo, moving.unionByName(placed), ["_above"]).select(
                "_id", F.col("_next").alias("_above"), (F.col("_far") + F.col("_add")).alias("_far"), "_root"
            )
        )
        arrived = stepped.filter("_root").select("_id", F.col("_far").alias("_depth"))
        if arrived.isEmpty():
            break
        done.append(arrived)
        todo = stepped.filter("NOT _root").drop("_root")
        reached *= 2
    depths = reduce(DataFrame.unionByName, done).select(F.col("_id").alias(id_col), F.col("_depth").alias(name))
    if max_depth is not None:
        depths = depths.filter(F.col(name) <= root_level + max_depth)
    return df.join(depths, id_col)


def densify(
    df: DataFrame, at: str, start: Column, stop: Column, step: str, fill: dict[str, object]
) -> DataFrame:
    """``generate_series(start, stop, step)`` left-joined to ``df`` on ``at``; gaps in ``fill`` columns get a default."""
    spark = df.sparkSession
    series = spark.range(1).select(F.explode(F.sequence(start, stop, F.expr(f"INTERVAL {step}"))).alias(at))
    return series.join(df, at, "left").fillna(fill)


def rollup_labelled(
    df: DataFrame,
    dims: Sequence[str],
    aggs: Sequence[Column],
    labels: dict[str, str],
    mark_totals_only: bool = False,
) -> DataFrame:
    """``GROUP BY ROLLUP`` with labelled totals.

    By default a real NULL in a dimension gets the label too, as COALESCE over the
    dimension does; ``mark_totals_only`` labels subtotal rows alone.
    """
    rolled = df.rollup(*dims).agg(*[F.grouping(d).alias(f"_g_{d}") for d in dims], *aggs)
    for d in dims:
        value = F.col(d).cast("string")
        if mark_totals_only:
            labelled = F.when(F.col(f"_g_{d}") == 1, F.lit(labels[d])).otherwise(value)
        else:
            labelled = F.coalesce(value, F.lit(labels[d]))
        rolled = rolled.withColumn(d, labelled)
    return rolled.drop(*[f"_g_{d}" for d in dims])


def ordered_list(value: str | Column, order: str | Column, separator: str = ", ") -> Column:
    """GROUP_CONCAT / STRING_AGG / LISTAGG of a group, ordered by (order, value).

    The result is one cell, so use it over pre-aggregated or ranked rows.
    """
    pairs = F.array_sort(F.collect_list(F.struct(as_column(order).alias("o"), as_column(value).cast("string").alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def distinct_list(value: str | Column, separator: str = ", ") -> Column:
    """``ARRAY_AGG(DISTINCT x ORDER BY x)`` as text."""
    return F.array_join(F.array_sort(F.collect_set(as_column(value).cast("string"))), separator)


def full_key_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only: ``side`` is ``left`` or ``right``."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    joined = a.join(b, list(keys), "full")
    return joined.filter(F.col("_a").isNull() | F.col("_b").isNull()).select(
        *keys, F.when(F.col("_b").isNull(), F.lit("left")).otherwise(F.lit("right")).alias("side")
    )


def lookup_with_missing(ids: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Every id with its detail columns and a ``missing`` flag; ``details`` has one row per key."""
    return lookup_join(ids, details.withColumn("_found", F.lit(True)), [key], "left", counted=True).withColumn(
        "missing", F.col("_found").isNull()
    ).drop("_found")
