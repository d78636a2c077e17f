"""A Merkle manifest of a dataset: roots, proofs, and the rows that no longer fold to the root.

A row's leaf is the SHA-256 of its fields. Within a group the leaves ascend by id, and while
several nodes remain, every ``ARITY`` consecutive ones become the SHA-256 of their digests
in hexadecimal. The groups' last nodes, ordered by group, go on in the same way to the root.

The tree is cut into superblocks of ``ARITY ** HEIGHT`` consecutive nodes. Going up, each
superblock is reduced in one task, and the nodes left are dealt into superblocks again,
until every group has one. Coming down, each superblock's nodes are cogrouped with the outer
nodes that its proofs need (for each level above it the run's digests to the left and to the
right): one function finishes the reduction inside the superblock, joins the outer nodes to
its proofs and folds them. So no task holds more than a superblock and the path above it,
and a node travels twice, however many rows a group has.

Defined cases: rows of one group with the same id, and rows without one (they come first),
are ordered by leaf; equal rows have equal leaves, so their order doesn't matter. NULL
fields count as ``-``, an empty text as ``0:``. NULL is a group of its own and comes before
all others. An empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.operators.ordering import checked_broadcast, null_safe_join, positions
from trilect.session import store

#: Nodes that become one.
ARITY = 8
#: Levels that are reduced in one task; a superblock has ARITY ** HEIGHT nodes.
HEIGHT = 4
BLOCK = ARITY**HEIGHT

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest, as 32 bytes, of the fields with their lengths."""
    parts = []
    for field in fields:
        value = field.cast("string")
        length = F.octet_length(value).cast("string")
        parts.append(F.coalesce(F.concat(length, F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], height: int | None) -> list[list[str]]:
    """The nodes level by level: ``height`` levels above the given ones, or up to a single node."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
    return levels


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """What a leaf and the digests beside its path come to."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _reduce(block: pd.DataFrame) -> pd.DataFrame:
    """One superblock's node: as the only one of its group (``alone``), and as one of several (``node``)."""
    block = block.sort_values("place")
    nodes = [d.hex() for d in block["digest"]]
    alone = levels_of(nodes, None)
    node = levels_of(alone[-1], HEIGHT + 1 - len(alone))[-1][0]
    out = block[["grp", "block"]].iloc[:1].copy()
    out["alone"], out["node"] = bytes.fromhex(alone[-1][0]), bytes.fromhex(node)
    return out


def _beside(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """For each level but the last, the digests of the node's run to its left and to its right."""
    out = []
    for nodes in levels[:-1]:
        begin = place - place % ARITY
        out.append(("".join(nodes[begin:place]), "".join(nodes[place + 1 : begin + ARITY])))
        place //= ARITY
    return out


def _placed(nodes: pd.DataFrame, outer: pd.DataFrame) -> tuple[pd.DataFrame, list[list[tuple[str, str]]]]:
    """A superblock's nodes in order, and each one's path: its part inside the superblock joined to the outer one."""
    nodes = nodes.sort_values("place")
    above = outer.iloc[0]
    levels = levels_of([d.hex() for d in nodes["digest"]], None if above["alone"] else HEIGHT)
    rest = list(zip(above["lefts"], above["rights"]))
    return nodes, [_beside(levels, k) + rest for k in range(len(nodes))]


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The path of every node of a superblock, and the group's last node."""
    nodes, paths = _placed(nodes, outer)
    out = nodes[["grp", "place"]].copy()
    out["lefts"] = [[left for left, _ in p] for p in paths]
    out["rights"] = [[right for _, right in p] for p in paths]
    out["top"] = [outer.iloc[0]["top"]] * len(out)
    return out


def _outer_nodes(nodes: DataFrame) -> DataFrame:
    """For every superblock of ``nodes`` (grp, place, digest): grp, block, alone, and what lies above it.

    ``alone`` says that the superblock is the group's only one; ``lefts`` and ``rights`` are the
    path from its node on, and ``top`` is the group's last node.
    """
    kind = nodes.schema["grp"].dataType.simpleString()
    dealt = nodes.select("grp", _block(), "place", "digest")
    reduced = store(
        dealt.groupBy("grp", "block").applyInPandas(_reduce, f"grp {kind}, block bigint, alone binary, node binary")
    )
    several = reduced.where("block = 1").select("grp", F.lit(True).alias("several"))
    known = null_safe_join(reduced, checked_broadcast(several), ["grp"], "left")
    none = F.array().cast("array<string>")
    single = known.where("several IS NULL").select(
        "grp", "block", F.lit(True).alias("alone"), none.alias("lefts"), none.alias("rights"), F.col("alone").alias("top")
    )
    upper = store(known.where("several").select("grp", F.col("block").alias("place"), F.col("node").alias("digest")))
    if upper.isEmpty():
        return store(single)
    above = with_paths(upper).select(
        "grp", F.col("place").alias("block"), F.lit(False).alias("alone"), "lefts", "rights", "top"
    )
    return store(single.unionByName(above))


def _block() -> Column:
    return F.expr(f"place div {BLOCK}").alias("block")


def _cogrouped(nodes: DataFrame, outer: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function`` over each superblock's nodes and the outer nodes that they need."""
    dealt = nodes.withColumn("block", _block())
    return dealt.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(function, schema)


def with_paths(nodes: DataFrame) -> DataFrame:
    """For every node (grp, place from 0, digest) its path to the group's last node, and that node as ``top``.

    ``lefts`` and ``rights`` hold, level by level, the digests of the run to the left and to the
    right of the path, as hexadecimal text in a row.
    """
    kind = nodes.schema["grp"].dataType.simpleString()
    schema = f"grp {kind}, place bigint, lefts array<string>, rights array<string>, top binary"
    return _cogrouped(nodes, _outer_nodes(nodes), _paths, schema)


def _proved(proofs: bool) -> Callable:
    """What the last exchange does with a superblock's rows; with ``proofs`` the proofs themselves are returned."""

    def function(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, paths = _placed(nodes, outer)
        above = outer.iloc[0]
        onward = list(zip(above["root_lefts"], above["root_rights"]))
        root = above["root"].hex()
        paths = [p + onward for p in paths]
        out = pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": [d.hex() for d in nodes["digest"]]})
        out["subroot"], out["root"] = above["top"].hex(), root
        out["proof_sha256"] = [digest("".join([left + right for left, right in p])) for p in paths]
        out["folded_root"] = [fold(d.hex(), p) for d, p in zip(nodes["found"], paths)]
        out["verified"] = out["folded_root"] == root
        if proofs:
            out["proof"] = [[left + right for left, right in p] for p in paths]
        return out

    return function


def manifest(
    rows: DataFrame,
    found: Column | None = None,
    doc_id: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    text: str = "text",
    proofs: bool = True,
) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof.

    ``found`` is the text that the verification meets, by default the same. ``proof`` has one text
    per level up to the root, the digests beside the path from left to right, and ``proof_sha256``
    is the hash of all of them in a row. Without ``proofs`` only the hash leaves the task.
    """
    met = F.col(text) if found is None else found
    leaves = rows.select(
        F.col(group).alias("grp"),
        F.col(doc_id).alias("doc_id"),
        leaf_of([F.col(f) for f in fields]).alias("digest"),
        leaf_of([met if f == text else F.col(f) for f in fields]).alias("found"),
    )
    kind = leaves.schema["doc_id"].dataType.simpleString()
    numbered = positions(leaves, ["doc_id", "digest"], within=["grp"])
    # Ids travel as text: pandas has no integers beside missing ones.
    nodes = store(
        numbered.select(
            "grp", F.col("doc_id").cast("string").alias("doc_id"), "digest", "found", (F.col("position") - 1).alias("place")
        )
    )
    outer = _outer_nodes(nodes.select("grp", "place", "digest"))
    subroots = outer.where("block = 0").select("grp", F.col("top").alias("digest"))
    ordered = store(
        positions(subroots, ["grp"]).select(
            F.col("grp").alias("of"), F.lit(0).alias("grp"), (F.col("position") - 1).alias("place"), "digest"
        )
    )
    onward = with_paths(ordered.drop("of")).select(
        "place", F.col("lefts").alias("root_lefts"), F.col("rights").alias("root_rights"), F.col("top").alias("root")
    )
    onward = store(ordered.join(onward, "place").select(F.col("of").alias("grp"), "root_lefts", "root_rights", "root"))
    whole = null_safe_join(outer, checked_broadcast(onward), ["grp"])
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = _cogrouped(nodes, whole, _proved(proofs), schema + (", proof array<string>" if proofs else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
