"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (in words) per source. A source's budget takes all
its documents as often as it can; of the remaining budget every length gives the whole
documents of its proportional share, and of the fractions that are left over it gives one
document more by a seeded draw in proportion to them. What the draw is kept from, twice the
longest document, is fitted by a bounded knapsack over the documents that are left, in a
seeded order. Where these can't make the sum, the draw gives back twice as much, and so on:
up to ``EXACT`` words, or all fractions of a source that has fewer. Which documents of a
length are taken is decided by a seeded order.

Defined cases: a NULL or blank text has size 0 and takes no words. NULL is a source of its
own, the last one; an empty name is an ordinary source. Rows that are repeated count each.
Ties of the seeded order are broken by doc_id; rows that agree in doc_id, source and size
are interchangeable. An input without words gives targets of 0, an empty one no rows.
Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.llm.shared import text_of, word_count
from trilect.operators.ordering import checked_broadcast, null_safe_join, positions
from trilect.session import cut, store

WEIGHTS = (3.0, 1.0, 2.0)
#: Mixed size over input size, and the most that a document or source is taken.
SHARE, MOST = 1.5, 2
SEED = 20240115
#: Words up to which the draw gives back for an exact sum, unless twice the longest document is more.
EXACT = 1 << 16


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of (source, source_size) rows the target of each.

    Weights go round by code point of the name. What a source can't hold is shared out
    again by weight until none is above its limit; each round sends two sums to the driver.
    """
    ordered = positions(sources, [F.col("source").asc_nulls_last()], name="_place")
    listed = F.array(*map(F.lit, weights))
    weighted = cut(ordered.withColumn("weight", F.get(listed, ((F.col("_place") - 1) % len(weights)).cast("int"))).drop("_place"))
    budget = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    limit = most * F.col("source_size")
    level = 0.0
    while True:
        held = limit <= level * F.col("weight")
        got = weighted.agg(
            F.coalesce(F.sum(F.when(held, limit)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        raised = (budget - got["full"]) / got["open"] if got["open"] else level
        if raised <= level:
            break
        level = raised
    return weighted.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = MOST, exact: int = EXACT, seed: int = SEED) -> tuple[int, np.ndarray]:
    """How often every document is taken, and how many of each length once more."""
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    size = sum(a * b for a, b in zip(lengths, counts))
    budget = min(round(target), most * size)
    if size == 0 or budget == most * size:
        return (most if size and budget else 0), np.zeros(len(lengths), np.int64)
    base, rest = divmod(budget, size)
    more = [rest * c // size for c in counts]
    left = [c - k for c, k in zip(counts, more)]
    rest -= sum(a * b for a, b in zip(lengths, more))
    fractions = [(budget % size) * c % size / size for c in counts]
    reserve, best = 2 * max(lengths), None
    while True:
        part = max(0.0, 1 - reserve / rest) if rest else 0.0
        drawn = draw(lengths, fractions, part, seed)
        need = rest - sum(a * b for a, b in zip(lengths, drawn))
        fitted, short = knapsack(lengths, [n - d for n, d in zip(left, drawn)], need, seed)
        if best is None or short < best[0]:
            best = short, [a + b + c for a, b, c in zip(more, drawn, fitted)]
        if not short or not part or reserve >= exact:
            return base, np.array(best[1], np.int64)
        reserve = min(2 * reserve, exact)


def draw(lengths: list[int], fractions: list[float], part: float, seed: int) -> list[int]:
    """One document or none of each length, by ``part`` of its fraction.

    In the order of length, the draw is never two documents off its share, so its words are
    less than twice the longest document off.
    """
    taken, place = [0] * len(lengths), float(np.random.default_rng(seed).random())
    for k in sorted((k for k in range(len(lengths)) if lengths[k]), key=lambda k: lengths[k]):
        place += fractions[k] * part
        if place >= 1:
            taken[k], place = 1, place - 1
    return taken


def knapsack(lengths: list[int], left: list[int], rest: int, seed: int) -> tuple[list[int], int]:
    """How many documents of each length come nearest to ``rest`` from below, and the words short of it.

    Lengths come in turn as in a seeded order of the documents left; it ends at an exact sum.
    """
    rng = np.random.default_rng(seed + 1)
    turn = rng.exponential(size=len(lengths)) / np.maximum(left, 1)
    # first[s] is the piece (length, number) by which s words were first reached.
    pieces: list[tuple[int, int]] = []
    first = np.full(rest + 1, -1, np.int32)
    first[0] = 0
    for k in np.argsort(turn, kind="stable"):
        n, step = min(left[k], rest // lengths[k]) if lengths[k] else 0, 1
        while n > 0 and first[rest] < 0:
            step = min(step, n)
            pieces.append((k, step))
            width = step * lengths[k]
            reached = np.flatnonzero((first[: rest + 1 - width] >= 0) & (first[width:] < 0))
            first[reached + width] = len(pieces)
            n, step = n - step, 2 * step
        if first[rest] >= 0:
            break
    words = int(np.flatnonzero(first >= 0)[-1])
    taken, short = [0] * len(lengths), rest - words
    while words:
        k, n = pieces[first[words] - 1]
        taken[k] += n
        words -= n * lengths[k]
    return taken, short


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
    also: Sequence[str] = (),
) -> DataFrame:
    """Per row doc_id, source, size, source_size, target, copies (how often it is taken) and taken (in words).

    The columns ``also`` are kept, and decide between rows of the same id.
    """
    sized = store(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text_of(text)).alias("size"), *also)
    )
    counted = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        base, more = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), rows["target"].iloc[0], most, seed=seed)
        return rows[["source", "size", "source_size", "target"]].assign(base=base, more=more)

    kind = sized.schema["source"].dataType.simpleString()
    # One row per distinct length of a source: as many as the longest document has words, at most.
    plans = cut(
        null_safe_join(counted, aims.select("source", "source_size", "target"), ["source"])
        .groupBy("source")
        .applyInPandas(plan, f"source {kind}, size bigint, source_size bigint, target double, base int, more bigint")
    )
    seeded: Column = F.xxhash64(F.lit(seed), "doc_id")
    placed = positions(sized.withColumn("_seeded", seeded), ["_seeded", "doc_id", *also], within=["source", "size"], name="_place")
    joined = null_safe_join(placed, checked_broadcast(plans), ["source", "size"])
    copies = F.col("base") + F.when(F.col("_place") <= F.col("more"), 1).otherwise(0)
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), *also
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    Rows that agree in doc_id, source and text share out their copies evenly; they are numbered
    over sorted ranges, so any number of them may agree (ids may be NULL throughout).
    """
    keys = ["doc_id", "source", "size", "of_text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = text_of(F.col("_doc.text"))
    rows = rows.withColumns(
        {"doc_id": F.col("_doc.doc_id"), "source": F.col("_doc.source"), "size": word_count(text), "of_text": F.xxhash64(text)}
    )
    taken = mix_sources(rows.withColumn("text", F.col("_doc.text")), also=["of_text"])
    share = cut(taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")))
    single = null_safe_join(rows, checked_broadcast(share.filter("n = 1").drop("n")), keys)
    several = null_safe_join(rows, checked_broadcast(share.filter("n > 1")), keys)
    placed = positions(several.withColumn("_at", F.monotonically_increasing_id()), ["_at"], within=keys, name="_place")
    extra = F.when(F.col("_place") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    shared = placed.withColumn("copies", F.expr("copies div n") + extra)
    each = single.select("_doc", "copies").unionByName(shared.select("_doc", "copies")).filter("copies > 0")
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_doc.*")
