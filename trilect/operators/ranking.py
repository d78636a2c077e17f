"""First rows per key and pages at any place, without a task that holds them all.

``numbered_top`` finds from a sample, per key, an order value that about ``n`` rows come
before; rows past it go where they lie, and only the rest is numbered. ``deep_page``
counts the rows of range partitions and sorts those alone that hold the page.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilect.operators.ordering import checked_broadcast, null_safe_join, positions
from trilect.session import cut, store

#: Up to so many rows per key Spark cuts keys down in the map tasks by itself.
NATIVE_ROWS = 1000
#: Of the first ``n`` rows of a key about so many are in the sample, and a sampled row so
#: far behind (seven standard deviations) is the cut-off.
SAMPLED = 600
CUT_RANK = SAMPLED + 7 * math.isqrt(SAMPLED)
SEED = 11


def ordering(order: Sequence[str | Column]) -> list[Column]:
    """Sort columns from columns, names, and names with `` DESC``; NULLs are the smallest values."""

    def one(c: str | Column) -> Column:
        if not isinstance(c, str):
            return c
        name = c.removesuffix(" DESC")
        return F.col(name).asc_nulls_first() if name == c else F.col(name).desc_nulls_last()

    return [one(c) for c in order]


def _not_after(order: Sequence[str], limit: str) -> Column:
    """Whether a row stands at or before the row whose order values are in the struct ``limit``."""
    out = F.lit(True)
    for k, c in reversed(list(enumerate(order))):
        name = c.removesuffix(" DESC")
        here, there = F.col(name), F.col(f"{limit}._{k}")
        low, high = (here, there) if name == c else (there, here)
        before = F.coalesce(low < high, low.isNull() & high.isNotNull())
        out = before | (here.eqNullSafe(there) & out)
    return out


def cut_offs(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """(keys, _limit): per key with enough rows, the order values of a row that about ``n`` rows, or more, come before."""
    names = [c.removesuffix(" DESC") for c in order]
    sample = df.select(*dict.fromkeys([*keys, *names])).where(F.rand(SEED) < SAMPLED / n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering(order)))
    limit = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(names)])
    last = sample.withColumn("_nth", rank).filter(F.col("_nth") <= CUT_RANK).filter(F.col("_nth") == CUT_RANK)
    return cut(last.select(*keys, limit.alias("_limit")))


def numbered_top(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, name: str = "position"
) -> DataFrame:
    """The first ``n`` rows of every key with their place from 1, for any ``n``.

    ``order`` is unique within a key. Where all of it are names (with `` DESC`` for descending),
    rows that can't be among the first are left out before the rows are dealt out; otherwise all
    rows are numbered over sorted ranges.
    """
    columns = ordering(order)
    if not all(isinstance(c, str) for c in order):
        return positions(df, columns, keys, name).filter(F.col(name) <= n)
    limits = cut_offs(df, keys, order, n)
    if limits.isEmpty():
        return positions(df, columns, keys, name).filter(F.col(name) <= n)
    limited = null_safe_join(df, checked_broadcast(limits), keys, "left")
    kept = limited.filter(F.col("_limit").isNull() | _not_after(order, "_limit")).drop("_limit")
    numbered = positions(kept, columns, keys, name)
    # A key of which less than n rows were left was cut too early: it is numbered whole.
    sizes = numbered.groupBy(*keys).agg(F.max(name).alias("_size"))
    early = null_safe_join(limits.select(*keys), sizes, keys, "left").filter(F.coalesce("_size", F.lit(0)) < n).select(*keys)
    early = cut(early.withColumn("_early", F.lit(True)))
    if not early.isEmpty():
        early = checked_broadcast(early)
        whole = null_safe_join(df, early, keys).drop("_early")
        rest = null_safe_join(numbered, early, keys, "left").filter("_early IS NULL").drop("_early")
        numbered = rest.unionByName(positions(whole, columns, keys, name))
    return numbered.filter(F.col(name) <= n)


def deep_page(df: DataFrame, order: Sequence[Column], offset: int, n: int) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``n`` in order, from the partitions that hold them.

    Rows are dealt into ranges of the order; the counts of the ranges (one number per partition)
    tell which ones hold the page, and the others are neither read nor sorted.
    """
    dealt = store(df.repartitionByRange(*order).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftrightunsigned("_mid", 33)
    counts = sorted((r["_pid"], r["count"]) for r in dealt.groupBy(pid.alias("_pid")).count().collect())
    before, held, begun = 0, [], 0
    for p, count in counts:
        if before < offset + n and before + count > offset:
            begun = begun if held else before
            held.append(p)
        before += count
    if not held:
        return df.limit(0)
    place = F.col("_mid").between(held[0] << 33, ((held[-1] + 1) << 33) - 1)
    return dealt.filter(place).drop("_mid").orderBy(*order).offset(offset - begun).limit(n)
