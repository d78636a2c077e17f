"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks of a fixed expected size, and every query
block meets every candidate block in a task of its own. There the candidates become
postings (per dimension the rows with a weight and the weights), each query scatters its
weighted postings into a dense score array, and the k best are taken by partition
selection. The best of all blocks are merged at the end.

Components become floor(scale * x) with x as double. Defined cases: rows with a NULL id or
vector, or with a NULL or non-finite component, take no part. A dimension that one of two
vectors lacks counts as 0, so an empty vector scores 0. A query meets no row of its own
id; other repeated rows are candidates each. A query that is repeated with the same vector
is answered once. Finite components of any size take part; a score that is to be returned
and that a long can't hold raises an error. Other columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilect.llm.shared import parts_for

CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 512
#: From here on doubles skip whole numbers, and products are worked out exactly.
EXACT = 2.0**53


def _dense(vectors: pa.ListArray | pa.ChunkedArray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column the row, dimension and weight of every component that isn't 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    parts = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        weights = np.floor(scale * parts)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    dims = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = weights != 0
    whole = weights[there]
    if len(whole) and np.abs(whole).max() >= EXACT:
        whole = np.array([math.floor(Fraction(x) * Fraction(scale)) for x in parts[there].tolist()], object)
    else:
        whole = whole.astype(np.int64)
    return rows[there], dims[there], whole


def best_of_block(queries: pa.Table, candidates: pa.Table, k: int, scale: float) -> dict[str, np.ndarray]:
    """For each query its k best candidates of this block: query row, candidate id, score, and past (1 above a long, -1 below)."""
    candidates = candidates.sort_by("vec_id")
    ids = candidates["vec_id"].to_numpy()
    rows, dims, weights = _dense(candidates["v"], scale)
    order = np.lexsort((rows, dims))
    rows, dims, weights = rows[order], dims[order], weights[order]
    n_dims = int(dims[-1]) + 1 if len(dims) else 0
    begins = np.searchsorted(dims, np.arange(n_dims + 1))
    q_rows, q_dims, q_weights = _dense(queries["v"], scale)
    bound = 0
    if len(weights) and len(q_weights):
        bound = int(np.abs(weights).max()) * int(np.abs(q_weights).max()) * n_dims
    # Where a sum might leave a long, the block's sums are Python integers.
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    of_kind = int if kind is object else kind
    weights = weights.astype(kind)
    postings = [(slice(None) if b - a == len(ids) else rows[a:b], weights[a:b]) for a, b in zip(begins, begins[1:])]
    q_begins = np.searchsorted(q_rows, np.arange(queries.num_rows + 1))
    scores = np.zeros(len(ids), kind)
    found: list[tuple[np.ndarray, ...]] = []
    for q, own in enumerate(queries["query_id"].to_numpy()):
        scores[:] = 0
        for d, w in zip(q_dims[q_begins[q] : q_begins[q + 1]], q_weights[q_begins[q] : q_begins[q + 1]]):
            if d < n_dims:
                where, posting = postings[d]
                scores[where] += of_kind(w) * posting
        a, b = np.searchsorted(ids, [own, own + 1])
        others = np.delete(np.arange(len(ids)), slice(a, b)) if b > a else np.arange(len(ids))
        mine = scores[others]
        if len(mine) > k:  # all above the k-th score, and of its equals those with the smallest ids
            least = np.partition(mine, len(mine) - k)[len(mine) - k]
            above, equal = np.flatnonzero(mine > least), np.flatnonzero(mine == least)
            pick = np.concatenate([above, equal[: k - len(above)]])
        else:
            pick = np.arange(len(mine))
        best = mine[pick]
        past = (best >= 2**63).astype(np.int64) - (best < -(2**63)).astype(np.int64) if kind is object else np.zeros(len(pick), np.int64)
        found.append((np.full(len(pick), q), ids[others[pick]], np.where(past == 0, best, 0).astype(np.int64), past))
    names = ("query", "vec_id", "score", "past")
    if not found:
        return {n: np.zeros(0, np.int64) for n in names}
    return {n: np.concatenate([f[i] for f in found]) for i, n in enumerate(names)}


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows; ``is_query`` is a condition on ``vec_id``."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    taking_part = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
    )
    asked = taking_part.filter("q").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates()
    sizes = taking_part.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    stripes, blocks = parts_for(sizes["n"], candidate_block), parts_for(sizes["q"], query_block)

    def dealt(column: str, parts: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = asked.withColumn("qb", dealt("query_id", blocks, 1)).withColumn("stripe", every(stripes))
    left = left.withColumn("same", F.xxhash64("v"))
    right = taking_part.select("vec_id", "v").withColumn("stripe", dealt("vec_id", stripes, 2)).withColumn("qb", every(blocks))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        best = best_of_block(q, c, k, scale)
        mine = best.pop("query")
        return pa.table(
            {"query_id": q["query_id"].to_numpy()[mine], "same": q["same"].to_numpy()[mine], **best},
            schema=pa.schema([(n, pa.int64()) for n in ("query_id", "same", "vec_id", "score", "past")]),
        )

    best = (
        left.groupBy("qb", "stripe")
        .cogroup(right.groupBy("qb", "stripe"))
        .applyInArrow(meet, "query_id bigint, same bigint, vec_id bigint, score bigint, past bigint")
    )
    order = Window.partitionBy("query_id", "same").orderBy(F.col("past").desc(), F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.col("past") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score is too large for a long")).cast("bigint"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
