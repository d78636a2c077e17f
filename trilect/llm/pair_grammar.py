"""Re-Pair: sequences written with a grammar whose rules replace the most frequent adjacent pair."""

from __future__ import annotations

import heapq
from collections import defaultdict


def compress(sequences: list[str]) -> tuple[list[list[int | str]], list[tuple[int | str, int | str]]]:
    """The sequences as lists of characters and rule numbers, and each rule's two symbols.

    Round by round the pair that occurs most often in all sequences (the first one found, of
    equals) becomes a rule and is replaced from left to right, until no pair occurs twice. Rules refer
    only to characters and to earlier rules. Only the places of the replaced pair are visited.
    """
    symbols: list[int | str | None] = []
    begins = []
    for s in sequences:
        begins.append(len(symbols))
        symbols.extend(s)
        symbols.append(None)  # no pair reaches over the end
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple, set[int]] = defaultdict(set)
    order: dict[tuple, int] = {}

    def pair_at(k: int) -> tuple | None:
        if not 0 <= k < n or after[k] >= n:
            return None
        a, b = symbols[k], symbols[after[k]]
        return None if a is None or b is None else (a, b)

    for k in range(n):
        if (pair := pair_at(k)) is not None:
            places[pair].add(k)
            order.setdefault(pair, len(order))
    waiting = [(-len(at), order[pair], pair) for pair, at in places.items()]
    heapq.heapify(waiting)
    rules: list[tuple[int | str, int | str]] = []
    while waiting:
        count, _, pair = heapq.heappop(waiting)
        if -count != len(places[pair]):
            if len(places[pair]) > 1:
                heapq.heappush(waiting, (-len(places[pair]), order[pair], pair))
            continue
        if -count < 2:
            break
        rule = len(rules)
        changed: set[tuple] = set()
        replaced = 0
        for k in sorted(places.pop(pair)):
            if pair_at(k) != pair:
                continue  # the left part of an overlap was replaced
            j = after[k]
            for neighbour in (before[k], j):
                if (old := pair_at(neighbour)) is not None and old != pair:
                    places[old].discard(neighbour)
            symbols[k], symbols[j] = rule, None
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            replaced += 1
            for neighbour in (before[k], k):
                if (new := pair_at(neighbour)) is not None:
                    places[new].add(neighbour)
                    order.setdefault(new, len(order))
                    changed.add(new)
        rules.append(pair)
        for new in changed:
            heapq.heappush(waiting, (-len(places[new]), order[new], new))
    out = []
    for begin in begins:
        k, symbols_left = begin, []
        while symbols[k] is not None:
            symbols_left.append(symbols[k])
            k = after[k]
        out.append(symbols_left)
    return out, rules
