"""Row positions over data of any size, and joins that survive hot keys.

``positions`` numbers rows the way ROW_NUMBER does, but no group is ever sorted
in one task: rows are range-partitioned on (group, order), so a group that holds
a third of the table is spread over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.functions.columns import as_column
from trilect.session import cut, store

# A side is broadcast only after it was measured and found within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20
# Over how many join keys rows without a key are spread.
SPREAD = 1024


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes; looks at ``rows`` + 1 rows at most."""

    def width(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + F.lit(16)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) + F.lit(16)
        return F.lit(16)

    row = reduce(lambda a, b: a + b, [width(f) for f in df.schema.fields], F.lit(16))
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("bigint")).alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if its counted size allows it, else ``df`` for a shuffle join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def range_sorted(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in range-partitioned order, on disk, with its place (_pid, _mid)."""
    order = [as_column(c) for c in order]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return store(placed).withColumn("_pid", F.shiftrightunsigned("_mid", 33))


def offsets_of(staged: DataFrame, within: Sequence[str], weights: dict[str, Column]) -> DataFrame:
    """Per (partition, group): its first row id and, by name, the weights of all earlier partitions.

    At most one row per partition and group meets in a window, however large the group.
    """
    sums = [F.sum(w).alias(f"_w_{name}") for name, w in weights.items()]
    parts = staged.groupBy("_pid", *within).agg(F.min("_mid").alias("_first"), *sums)
    earlier = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = [
        F.coalesce(F.sum(f"_w_{name}").over(earlier), F.lit(0)).cast("bigint").alias(name) for name in weights
    ]
    return cut(parts.select("_pid", *within, "_first", *before))


def positions(
    df: DataFrame,
    order: Sequence[str | Column],
    within: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Exact 1-based row numbers by ``order``, restarting in every ``within`` group.

    ``order`` must be unique within a group for the numbering to be repeatable.
    """
    staged = range_sorted(df, [*within, *order])
    offsets = offsets_of(staged, within, {"_before": F.lit(1)})
    joined = null_safe_join(staged, checked_broadcast(offsets), ["_pid", *within])
    return joined.select(*df.columns, (F.col("_before") + F.col("_mid") - F.col("_first") + F.lit(1)).alias(name))


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", counted: bool = False
) -> DataFrame:
    """Join ``left`` to ``right``, where ``right`` has at most one row per key; ``left`` is read once.

    A hot key's rows are split at run time (``session.configure`` sees to it), each part
    meeting the same right row. Rows without a key match nothing and are spread over
    ``SPREAD`` partitions' worth of keys instead of meeting in one. ``how`` is inner, left,
    left_semi or left_anti. ``counted`` says that ``right`` is cheap to measure (a table, a
    checkpoint), so that it is broadcast whole when it turns out small.
    """
    if counted and small_enough(right):
        return left.join(F.broadcast(right), list(on), how)
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    hashed = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    place = F.pmod(F.xxhash64(*hashed), F.lit(SPREAD)).cast("int")
    spread = left.withColumn("_place", F.when(absent, place).otherwise(0))
    joined = spread.join(right.withColumn("_place", F.lit(0)), [*on, "_place"], how)
    return joined.drop("_place")
