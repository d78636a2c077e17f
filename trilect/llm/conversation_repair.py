"""Repair of conversation structure by dynamic programming over a grammar.

A conversation is repaired when its roles' initials read ``(s?(ua)+)?``. Its rows become a
sequence of symbols, one for the role and the fault of a row. Every symbol has a transfer
matrix over the pattern's four states: from each state to each, the least cost of editing the
row, with the edits written down (its audit), insertions before the row included. Matrices
multiply in the min-plus way, and audits are ropes, so a product only points to its factors.
The distinct sequences of a slice are written with a Re-Pair grammar; each rule's matrix
is computed once, bottom-up, from its two symbols', and all conversations that hold the rule
share it.

Equal costs are decided by the audits, the ASCII-least first. That is sound in products: the
state and an edit fix the role it gives, so an audit fixes its cost, and an audit of
the same rows from the same state that goes on after another one only has more
insertions and costs more. So of equally cheap audits none begins with another one,
and the least of the products is the product of the least.

Sequences are cut into blocks of ``BLOCK`` rows. A second step goes through the blocks of a
conversation with their costs and the order of their audits (32 numbers a block) and finds the
states between blocks; the audits are looked up afterwards. Texts are put together in
chunks inside the blocks, and a conversation's hash reads its chunks in order as a
stream, which SHA-256 doesn't allow to split.

Defined cases: a NULL role or text counts as one space, and so does a NULL id or turn in the key of
the damage. Rows are taken by turn, NULLs first; rows of one turn by role and then by the
hash of their text before the damage. Rows with a NULL conv_id are one conversation. A role with another
initial than s, u or a is legal nowhere; an empty one is such a role. A conversation of which no
row is left has zeros, an empty audit and the hash of an empty text. An empty table has no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trilect.llm.pair_grammar import compress
from trilect.llm.shared import BLANKS
from trilect.operators.ordering import lookup_join, null_safe_join, positions
from trilect.session import store

#: Rows of a conversation that are one sequence.
BLOCK = 256
#: Symbols of distinct sequences that share a grammar.
GRAMMAR_SYMBOLS = 1 << 17
#: Characters of repaired text that become one chunk.
CHUNK_CHARS = 1 << 20
#: Roles' initials that may follow each other.
LEGAL = ("su", "ua", "au")
#: The numbers of a conversation.
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

# States: nothing yet, after the system's row, after a user's, after the assistant's.
STATES = range(4)
#: Where the role that is due leads: a user's row from 0, 1 and 3, the assistant's from 2.
DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Audits are written with the role that an edit gives: I and R for the user, i and r for the assistant.
ASSISTANT = {"I": "i", "R": "r"}
ROLES = {"I": "user", "R": "user", "i": "assistant", "r": "assistant"}

Cell = tuple[int, "Rope"] | None
Matrix = list[list[Cell]]


class Rope:
    """A text as the join of two others; it is spelled out when asked for, and then kept."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self._text, self.left, self.right = text, left, right

    def text(self) -> str:
        if self._text is None:
            parts, waiting = [], [self]
            while waiting:
                rope = waiting.pop()
                if rope._text is not None:
                    parts.append(rope._text)
                else:
                    waiting += [rope.right, rope.left]
            self._text = "".join(parts)
        return self._text


def better(a: Cell, b: Cell) -> bool:
    """Whether ``a`` is cheaper than ``b``, or as cheap with the smaller audit."""
    if a is None or b is None:
        return a is not None
    return a[0] < b[0] or (a[0] == b[0] and a[1].text().upper() < b[1].text().upper())


def written(edit: str, state: int) -> str:
    return ASSISTANT[edit] if DUE[state] == "a" else edit


def insertions(state: int) -> Iterator[tuple[int, str, int]]:
    """The states that insertions reach, with the audit and the cost; going round again only costs more."""
    audit, seen = "", []
    while state not in seen:
        yield state, audit, INSERT * len(audit)
        seen.append(state)
        audit += written("I", state)
        state = NEXT[state, DUE[state]]


def matrix_of(symbol: str) -> Matrix:
    """The matrix of one row: s, u, a or o for its role, in capitals if truncated; x must be deleted."""
    out: Matrix = [[None] * 4 for _ in STATES]
    role, more = symbol.lower(), TRUNCATED * symbol.isupper()
    for start in STATES:
        for state, audit, cost in insertions(start):
            edits = [("D", state, DELETE)]
            if symbol != "x":
                edits.append((written("R", state), NEXT[state, DUE[state]], REROLE + more))
                if (state, role) in NEXT:
                    edits.append(("K", NEXT[state, role], more))
            for edit, end, price in edits:
                cell = (cost + price, Rope(audit + edit))
                if better(cell, out[start][end]):
                    out[start][end] = cell
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for start in STATES:
        for middle in STATES:
            if (first := a[start][middle]) is None:
                continue
            for end in STATES:
                if (second := b[middle][end]) is not None:
                    cost, best = first[0] + second[0], out[start][end]
                    if best is None or cost <= best[0]:
                        cell = (cost, Rope(None, first[1], second[1]))
                        if better(cell, best):
                            out[start][end] = cell
    return out


def matrices(sequences: list[str]) -> list[Matrix]:
    """The matrix of each sequence, by one grammar for all of them."""
    written_out, rules = compress(sequences)
    of: dict[int | str, Matrix] = {s: matrix_of(s) for s in set("".join(sequences))}
    for k, (left, right) in enumerate(rules):
        of[k] = product(of[left], of[right])
    out = []
    for symbols in written_out:
        whole = of[symbols[0]]
        for s in symbols[1:]:
            whole = product(whole, of[s])
        out.append(whole)
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each sequence 16 costs (-1: impossible), the audits, and the order of the audits from a state."""
    sequences: list[str] = []

    def solve() -> pa.RecordBatch:
        costs, orders, audits = [], [], []
        for matrix in matrices(sequences):
            cells = [cell for row in matrix for cell in row]
            costs.append([-1 if c is None else c[0] for c in cells])
            texts = ["" if c is None else c[1].text() for c in cells]
            audits.append(texts)
            order = [0] * 16
            for start in STATES:
                for place, k in enumerate(sorted(range(4 * start, 4 * start + 4), key=lambda k: texts[k].upper())):
                    order[k] = place
            orders.append(order)
        columns = [
            pa.array(sequences, pa.string()),
            pa.array(costs, pa.list_(pa.int32())),
            pa.array(orders, pa.list_(pa.int32())),
            pa.array(audits, pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["seq", "costs", "orders", "audits"])

    held = 0
    for batch in batches:
        for s in batch.column(0).to_pylist():
            sequences.append(s)
            held += len(s)
            if held >= GRAMMAR_SYMBOLS:
                yield solve()
                sequences, held = [], 0
    if sequences:
        yield solve()


#: What is inserted after the last row, by the state there.
TAILS = {0: "", 1: "Ii", 2: "i", 3: ""}


def route(costs: list[list[int]], orders: list[list[int]]) -> tuple[int, list[int], str]:
    """The least cost, the state before each block and after the last, and the insertions at the end."""
    ahead = [INSERT * len(TAILS[s]) for s in STATES]
    best = [ahead]
    for block in reversed(costs):
        ahead = [
            min((block[4 * s + t] + ahead[t] for t in STATES if block[4 * s + t] >= 0 and ahead[t] >= 0), default=-1)
            for s in STATES
        ]
        best.append(ahead)
    best.reverse()
    states = [0]
    for k, (block, order) in enumerate(zip(costs, orders)):
        s = states[-1]
        ends = [t for t in STATES if block[4 * s + t] >= 0 and best[k + 1][t] >= 0]
        states.append(min((t for t in ends if block[4 * s + t] + best[k + 1][t] == best[k][s]), key=lambda t: order[4 * s + t]))
    return best[0][0], states, TAILS[states[-1]]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) as the crc32 of ``conv_id:turn``, modulo 20, damages them.

    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = (F.crc32(key.cast("binary")) % 20).cast("int")
    filled = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")
    ).where("kind <> 0")
    return filled.select(
        "conv_id",
        "turn",
        F.col("role").alias("first_role"),
        F.sha2("text", 256).alias("first_text"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def numbered(rows: DataFrame) -> DataFrame:
    """Damaged rows in their conversations' order, with their place from 0, their block and what tells faults; stored."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    tested = rows.withColumns(
        {
            "text_key": F.unhex(F.substring(F.sha2("text", 256), 1, 32)),
            "blank": body == "",
            "truncated": ~F.substring(body, -1, 1).isin(".", "!", "?"),
        }
    )
    order = ["turn", "first_role", "first_text", "copy"]
    placed = positions(tested, order, within=["conv_id"]).drop(*order[1:])
    placed = placed.withColumn("place", F.col("position") - 1).drop("position")
    return store(placed.withColumn("block", F.expr(f"place div {BLOCK}")))


def _blocks(placed: DataFrame) -> DataFrame:
    """Each block's sequence of symbols, and what the conversation's numbers are summed from."""
    keys = ["conv_id", "role", "text_key"]
    first = placed.groupBy(keys).agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n")).where("n > 1")
    told = null_safe_join(placed.drop("text"), first.drop("n"), keys, "left")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("place") > F.col("first_place"), "duplicate")
        .when(F.col("truncated"), "truncated")
        .otherwise("none")
    )
    told = told.withColumn("fault", fault).withColumn("initial", _initial())
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )
    items = F.array_sort(F.collect_list(F.struct("place", symbol.alias("symbol"), "initial", "turn")))
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    found = told.groupBy("conv_id", "block").agg(items.alias("items"), *counts)
    initials = F.col("items.initial")
    pairs = F.zip_with(initials, F.slice(initials, 2, BLOCK), lambda a, b: F.concat(a, b))  # the last one is NULL
    turns = F.filter(F.col("items.turn"), lambda t: t.isNotNull())
    return found.select(
        "conv_id",
        "block",
        F.array_join("items.symbol", "").alias("seq"),
        "blank",
        "duplicate",
        "truncated",
        F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("bigint").alias("illegal"),
        F.element_at(initials, 1).alias("first"),
        F.element_at(initials, -1).alias("last"),
        F.array_min(turns).alias("low"),
        F.array_max(turns).alias("high"),
        F.size(F.array_distinct(turns)).cast("bigint").alias("turns"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``size`` rows and about ``limit`` characters."""
    held, length = [], 0
    for row in rows:
        held.append(row)
        length += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or length >= limit:
            yield _batch(held, schema)
            held, length = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _sorted_within(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _routed(rows: Iterator[dict]) -> Iterator[tuple]:
    """For each conversation a row with its numbers (block -1), and for each block the states around it."""
    for conv_id, group in groupby(rows, lambda r: r["conv_id"]):
        blocks = [r for r in group if r["block"] >= 0]
        cost, states, tail = route([r["costs"] for r in blocks], [r["orders"] for r in blocks])
        sums = [sum(r[c] for r in blocks) for c in ("blank", "duplicate", "truncated", "illegal")]
        low = high = None
        turns = 0
        for r, following in zip(blocks, [*blocks[1:], None]):
            if following and r["last"] + following["first"] not in LEGAL:
                sums[3] += 1
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        gaps = 0 if low is None else high - low + 1 - turns
        yield conv_id, -1, None, 0, states[-1], gaps, *sums, cost if blocks else 0, tail if blocks else ""
        for r, start, end in zip(blocks, states, states[1:]):
            yield conv_id, r["block"], r["seq"], start, end, 0, 0, 0, 0, 0, 0, ""


def _edited(rows: Iterator[dict]) -> Iterator[tuple]:
    """The rows of each block after its edits; the block's audit comes before its rows."""
    for (conv_id, block), group in groupby(rows, lambda r: (r["conv_id"], r["block"])):
        edits = iter(re.findall("[Ii]*[DKRr]", next(group)["text"]))
        for r, edit in zip(group, edits):
            for step, role in enumerate(edit[:-1]):
                yield conv_id, block, r["place"], step, ROLES[role], ""
            if edit[-1] != "D":
                yield conv_id, block, r["place"], len(edit) - 1, ROLES.get(edit[-1], r["role"]), r["text"]


def _chunked(rows: Iterator[dict]) -> Iterator[tuple]:
    """The repaired lines of each block, joined into chunks."""
    for (conv_id, block), group in groupby(rows, lambda r: (r["conv_id"], r["block"])):
        lines, size, chunk = [], 0, 0
        for r in group:
            lines.append(f"{r['role']}:{r['text']}")
            size += len(lines[-1])
            if size >= CHUNK_CHARS:
                yield conv_id, block, chunk, "\n".join(lines)
                lines, size, chunk = [], 0, chunk + 1
        if lines:
            yield conv_id, block, chunk, "\n".join(lines)


def _summed_up(rows: Iterator[dict]) -> Iterator[tuple]:
    """One row per conversation from its numbers, audits (chunk -1) and chunks, read in order."""
    for conv_id, group in groupby(rows, lambda r: r["conv_id"]):
        head = next(group)
        audits, told, begun = [], hashlib.sha256(), False
        for r in group:
            if r["chunk"] < 0:
                audits.append(r["text"].upper())
            else:
                told.update((("\n" if begun else "") + r["text"]).encode())
                begun = True
        for role in head["text"]:
            told.update((("\n" if begun else "") + ROLES[role] + ":").encode())
            begun = True
        audits.append(head["text"].upper())
        yield conv_id, *(head[c] for c in NUMBERS), "".join(audits), told.hexdigest()


def _mapped(rows: DataFrame, function: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``function`` over the rows of each partition in their order."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(function(_rows(batches)), arrow)

    return rows.mapInArrow(run, kind)


class Repair:
    """The repair of a table's conversations: ``rows`` are the repaired rows, ``summary`` has one row per conversation."""

    def __init__(self, conversations: DataFrame):
        source = conversations.select("conv_id", "turn", "role", "text")
        kind = source.schema["conv_id"].dataType.simpleString()
        self.kind = kind
        self.placed = numbered(damaged(source))
        blocks = store(_blocks(self.placed))
        solved = "seq string, costs array<int>, orders array<int>, audits array<string>"
        self.solved = store(blocks.select("seq").distinct().mapInArrow(_solved, solved))
        costed = lookup_join(blocks, self.solved.drop("audits"), ["seq"])
        every = source.select("conv_id").distinct().withColumn("block", F.lit(-1).cast("bigint"))
        ordered = _sorted_within(costed.unionByName(every, allowMissingColumns=True), ["conv_id"], ["block"])
        routed = (
            f"conv_id {kind}, block bigint, seq string, start int, end int, gaps bigint, blank bigint, duplicate bigint, "
            "truncated bigint, illegal bigint, cost bigint, tail string"
        )
        self.routed = store(_mapped(ordered, _routed, routed))
        taken = lookup_join(self.routed.where("block >= 0"), self.solved.select("seq", "audits"), ["seq"])
        self.audits = taken.select("conv_id", "block", F.expr("audits[4 * start + end]").alias("text"))

    @property
    def rows(self) -> DataFrame:
        """conv_id, block, place and step (their order in the conversation), role, text; insertions at the end are in ``summary``."""
        texts = self.placed.select("conv_id", "block", "place", "role", "text")
        audits = self.audits.select("conv_id", "block", F.lit(-1).cast("bigint").alias("place"), F.lit("").alias("role"), "text")
        ordered = _sorted_within(audits.unionByName(texts), ["conv_id", "block"], ["place"])
        return _mapped(ordered, _edited, f"conv_id {self.kind}, block bigint, place bigint, step int, role string, text string")

    @property
    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        chunks = _mapped(self.rows, _chunked, f"conv_id {self.kind}, block bigint, chunk int, text string")
        audits = self.audits.select("conv_id", "block", F.lit(-1).alias("chunk"), "text")
        heads = self.routed.where("block < 0").select(
            "conv_id", "block", F.lit(-1).alias("chunk"), F.col("tail").alias("text"), *NUMBERS
        )
        parts = heads.unionByName(audits, allowMissingColumns=True).unionByName(chunks, allowMissingColumns=True)
        numbers = ", ".join(f"{c} bigint" for c in NUMBERS)
        return _mapped(
            _sorted_within(parts, ["conv_id"], ["block", "chunk"]),
            _summed_up,
            f"conv_id {self.kind}, {numbers}, audit string, repaired_sha256 string",
        )


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the damaged table; see ``Repair.summary``."""
    return Repair(conversations).summary
