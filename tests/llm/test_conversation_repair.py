import heapq
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from trilect.llm import conversation_repair as C
from trilect.llm.pair_grammar import compress

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, place string, seq int, cost string, kind string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def rows_of(*rows):
    return [(*r, "x", "y", 1, "z", "k") for r in rows]


def cheapest(symbols):
    """The least (cost, audit) and the roles it gives, from a search over all edits in order of cost and audit."""
    waiting, seen = [(0, "", 0, "", ())], set()
    while waiting:
        cost, audit, k, roles, kept = heapq.heappop(waiting)
        if (k, roles[-1:], roles == "s") in seen:
            continue
        seen.add((k, roles[-1:], roles == "s"))
        if k == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, kept
        steps = [(2, "I", k, r, ((r, None),)) for r in "ua"]
        if k < len(symbols):
            role, must_go, cut = symbols[k]
            steps.append((3, "D", k + 1, "", ()))
            if not must_go:
                steps.append((cut, "K", k + 1, role, ((None, k),)))
                steps += [(2 + cut, "R", k + 1, r, ((r, k),)) for r in "ua"]
        for price, edit, to, role, more in steps:
            if re.fullmatch("s|s?(ua)*u?", roles + role):
                heapq.heappush(waiting, (cost + price, audit + edit, to, roles + role, kept + more))
    raise AssertionError


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        first = (turn is not None, turn or 0, role, sha256(text.encode()).hexdigest())
        if k == 0:
            continue
        changed = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        out += [(first, turn, "user" if k == 4 else role, changed)] * (2 if k == 3 else 1)
    return [r[1:] for r in sorted(out, key=lambda r: r[0])]


def brute(rows):
    out = []
    for conv_id in {r[0] for r in rows}:
        left = damage([r[:4] for r in rows if r[0] == conv_id])
        seen, symbols, faults = set(), [], Counter()
        for _, role, text in left:
            body = WORD.findall(text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit, kept = cheapest(symbols)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{left[k][1] if name is None else names[name]}:{'' if k is None else left[k][2]}" for name, k in kept]
        turns = [r[0] for r in left if r[0] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        told = sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, told))
    return sorted(out, key=repr)


def check(spark, rows):
    got = C.repair(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["conv_id", *C.NUMBERS, "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_the_grammar_spells_the_sequences():
    rng = random.Random(1)
    given = ["".join(rng.choice("uaS") for _ in range(rng.randrange(1, 60))) for _ in range(80)] + ["uuuuuuu", "uaua" * 30, "x"]
    written, rules = compress(given)
    spelled = {}
    for k, pair in enumerate(rules):
        spelled[k] = "".join(spelled.get(s, s) for s in pair)  # rules know earlier rules only
    assert ["".join(spelled.get(s, s) for s in w) for w in written] == given
    assert sum(map(len, written)) + 2 * len(rules) < sum(map(len, given)) / 2
    assert not any(n > 1 for n in Counter(p for w in written for p in set(zip(w, w[1:]))).values())


def test_matrices_equal_a_search():
    rng = random.Random(2)
    given = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    for sequence, matrix in zip(given, C.matrices(given)):
        cells = [[-1 if c is None else c[0] for row in matrix for c in row]]
        order = [0] * 16
        texts = ["" if c is None else c[1].text() for row in matrix for c in row]
        for s in range(4):
            for place, k in enumerate(sorted(range(4 * s, 4 * s + 4), key=lambda k: texts[k].upper())):
                order[k] = place
        cost, states, tail = C.route(cells, [order])
        symbols = [(c.lower() if c != "x" else "u", c == "x", int(c.isupper())) for c in sequence]
        assert (cost, (texts[states[1]] + tail).upper()) == cheapest(symbols)[:2]


def table(spark, data_dir):
    return [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").collect()]


def test_conversations(spark, data_dir):
    check(spark, rows_of(*table(spark, data_dir)))


def test_odd_rows(spark):
    check(
        spark,
        rows_of(
            (1, None, "user", "Hi."), (1, 2, None, "Yes."), (1, 2, "assistant", None), (1, 2, "assistant", ""), (1, 9, "tool", "x!"),
            (2, 1, None, None), (None, None, None, None), (None, 3, "user", "What?"), (None, 3, "user", "What?"), (3, 5, "", "a b."),
            (4, -5, "system", "s."), (4, 7, "system", "s."), (5, 1, "user", "long " * 50_000), (5, 1, "user", "long " * 50_000),
            (6, 1, "assistant", " \t\n "), (7, 10**12, "assistant", "A.\x0b"), (7, -(10**12), "user", "é日😀?"),
        ),
    )
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    """Blocks of three rows and chunks of 40 characters give what one block gives, ties included."""
    monkeypatch.setattr(C, "BLOCK", 3)
    monkeypatch.setattr(C, "CHUNK_CHARS", 40)
    rng = random.Random(3)
    rows = [
        (c, rng.choice([None, *range(t, t + 3)]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "b", "", "Cc!", "d?", f"{t}."]))
        for c in range(25)
        for t in range(rng.randrange(1, 40))
    ]
    check(spark, rows_of(*rows))


def test_repaired_rows(spark):
    given = [(1, t, r, f"{t}.") for t, r in enumerate(["user", "user", "assistant", "user"])]
    repaired = C.Repair(spark.createDataFrame(rows_of(*given), SCHEMA)).rows.orderBy("block", "place", "step").collect()
    left = damage(given)
    assert all(r.role in ("user", "assistant") for r in repaired)
    assert [r.text for r in repaired if r.text] == [t for _, _, t in left if t in {r.text for r in repaired}]


@pytest.mark.parametrize("symbol", "suaoSUAOx")
def test_a_row_costs_what_its_edits_cost(symbol):
    matrix = C.matrix_of(symbol)
    more = int(symbol.isupper())
    prices = {"I": 2, "D": 3, "K": more, "R": 2 + more}
    for row in matrix:
        for cell in filter(None, row):
            assert cell[0] == sum(prices[e] for e in cell[1].text().upper())
