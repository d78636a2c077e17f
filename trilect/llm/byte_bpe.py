"""Byte-level BPE encoding and decoding as a reduction up a tree.

The tokens of a byte string are those that merging leaves: of all adjacent tokens whose
bytes together form a token, the pair with the lowest rank is merged, the leftmost of
equals, until none is left. ``Ranks.encode`` halves a string down to single bytes and joins
the halves' tokens on the way up. ``Ranks.join`` merges a window around the boundary anew
from its bytes, first one token on either side, and doubles a side until the window's
outermost token there comes out unchanged or the side is used up. The short strings of a slice go up their trees side by
side in arrays (``encode_side_by_side``).

What lies outside such a window then stands. Merges are never undone, so adjacent tokens
of a finished string are what merging the bytes of these two alone gives. In the joined
string every adjacent pair is of that kind: outside and across the window's edges by the
halves, inside by the window. Suppose some merge crossed a boundary between two of its
tokens, and take the first one: up to then the bytes of these two were merged as they are
alone, so the same merge would have been made there, and it wasn't. Joining is therefore
associative, and the empty string is its neutral element.

A text is cut by the pattern first, and each match is encoded separately; a match that is a
token by itself is that token, as in the tiktoken library. Characters that the library's
Unicode tables don't know as letters or numbers are neither here. Decoding joins the bytes
of neighbouring tokens up the tree, all texts of a slice side by side.

Defined cases: a NULL or empty text has no ids and decodes to no bytes. Texts over a
million characters are cut into matches a piece at a time. Strings that name special
tokens are ordinary text. Repeated rows are encoded one by one, NULL ids stay. Only the two
named columns are read. A byte that is no token of the vocabulary raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.llm.pieces import Pieces
from trilect.llm.shared import slices

#: Text bytes that are encoded at a time.
SLICE_BYTES = 2 << 20
#: Characters of a text that are cut into matches at a time.
CUT_CHARS = 1 << 20
#: Matches, halves of matches and windows that a worker remembers, of each.
REMEMBERED = 1 << 18
#: Halves up to so many bytes, and windows up to so many tokens, are remembered.
SHORT, FEW = 8, 4
#: Windows of more bytes are merged with a heap.
PLAIN = 48
#: Matches of more bytes are encoded one by one, all others side by side.
LONG = 64
#: Above every rank.
NONE = 1 << 62


def merged(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """What merging leaves of ``parts``, which are single bytes."""
    if len(parts) > PLAIN:
        return _merged_by_heap(parts, ranks)
    rank = ranks.get
    found = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while found and (best := min(found)) < NONE:
        k = found.index(best)
        parts[k] += parts.pop(k + 1)
        del found[k]
        if k < len(found):
            found[k] = rank(parts[k] + parts[k + 1], NONE)
        if k:
            found[k - 1] = rank(parts[k - 1] + parts[k], NONE)
    return parts


def _merged_by_heap(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
    heapq.heapify(waiting)

    def offer(k: int, j: int) -> None:
        both = parts[k] + parts[j]
        if (r := ranks.get(both)) is not None:
            heapq.heappush(waiting, (r, k, len(both)))

    while waiting:
        _, k, size = heapq.heappop(waiting)
        j = after[k]
        if not parts[k] or j >= n or len(parts[k]) + len(parts[j]) != size:
            continue  # one of the two was merged meanwhile
        parts[k] += parts[j]
        parts[j] = b""
        j = after[k] = after[j]
        if j < n:
            before[j] = k
            offer(k, j)
        if before[k] >= 0:
            offer(before[k], k)
    return [p for p in parts if p]


class Ranks:
    """A vocabulary of byte strings with their ranks, which are their ids.

    ``strangers`` are characters that the pattern is to take for symbols.
    """

    def __init__(self, path: str, pattern: str, strangers: str = ""):
        import regex

        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.rank_of = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = {rank: token for token, rank in self.rank_of.items()}
        table = [b""] * (max(self.bytes_of, default=-1) + 1)
        for rank, token in self.bytes_of.items():
            table[rank] = token
        self.table = pa.array(table, pa.large_binary())
        self._prepare_arrays(table)
        self.pattern = regex.compile(pattern)
        self.as_symbols = dict.fromkeys(map(ord, strangers), "†")
        self.is_stranger = np.zeros(0x110000, bool)
        self.is_stranger[list(self.as_symbols)] = True
        self.windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.closed: dict[bytes, tuple[int, ...]] = {}  # tokens that their own bytes merge to
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.wholes: dict[bytes, tuple[int, ...]] = {}

    def _prepare_arrays(self, table: list[bytes]) -> None:
        """What ``encode_side_by_side`` looks up: the token of each byte, each token's bytes, and the merges of two."""
        self.size = len(table)
        self.of_byte = np.array([self.rank_of.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.spelled = self.of_byte[np.frombuffer(b"".join(table), np.uint8)]
        rank, pairs = self.rank_of.get, []
        for token, merged_rank in self.rank_of.items():
            for k in range(1, len(token)):
                if (a := rank(token[:k])) is not None and (b := rank(token[k:])) is not None:
                    pairs.append((a * self.size + b, merged_rank))
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [0], np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at].astype(float), np.inf), self.pair_ranks[at]

    _side_by_side = Pieces._side_by_side  # merges best pairs of many strings in step; ranks are the costs

    def _again_all(self, tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``again`` for many windows of ``tokens``: all new tokens in a row, and how many each window has."""
        sizes = ends - begins
        window = tokens[_spans(begins, sizes)]
        of_window = np.repeat(np.arange(len(begins)), sizes)
        symbols = self.spelled[_spans(self.begins[window], self.lengths[window])]
        owner = np.repeat(of_window, self.lengths[window])
        found = list(self._side_by_side(symbols, owner))
        if not found:
            return symbols, np.zeros(len(begins), np.int64)
        new, owner = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        return new[order], np.bincount(owner, minlength=len(begins))

    def _join_all(self, tokens: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
        """``join`` of many neighbours, [low, middle) with [middle, high) of ``tokens``; what is between stays."""
        kept = np.ones(len(tokens), bool)
        added, places = [], []
        i = j = np.ones(len(middle), np.int64)
        first = True
        while len(middle):
            begins, ends = np.maximum(low, middle - i), np.minimum(high, middle + j)
            if first:  # pairs of tokens: most occur often, so each is merged once
                _, one, which = np.unique(tokens[begins] * self.size + tokens[begins + 1], return_index=True, return_inverse=True)
                new, counts = self._again_all(tokens, begins[one], ends[one])
                new, counts = new[_spans((np.cumsum(counts) - counts)[which], counts[which])], counts[which]
                first = False
            else:
                new, counts = self._again_all(tokens, begins, ends)
            last = np.cumsum(counts) - 1
            left = (begins == low) | (new[last - counts + 1] == tokens[begins])
            right = (ends == high) | (new[last] == tokens[ends - 1])
            done = left & right
            kept[_spans(begins[done], (ends - begins)[done])] = False
            added.append(new[np.repeat(done, counts)])
            places.append(np.repeat(begins[done], counts[done]))
            i, j = np.where(left, i, 2 * i)[~done], np.where(right, j, 2 * j)[~done]
            low, middle, high = low[~done], middle[~done], high[~done]
        at = np.concatenate([np.flatnonzero(kept), *places])
        return np.concatenate([tokens[kept], *added])[np.argsort(at, kind="stable")]

    def encode_side_by_side(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all strings in a row, and how many each has: neighbours of 1, 2, 4, ... bytes are joined."""
        sizes = np.array([len(s) for s in strings], np.int64)
        starts = np.cumsum(sizes) - sizes
        tokens = self.of_byte[np.frombuffer(b"".join(strings), np.uint8)]
        if len(tokens) and tokens.min() < 0:
            raise ValueError("a byte is no token of the vocabulary")
        span, most = 1, sizes.max(initial=0)
        while True:
            at = np.cumsum(self.lengths[tokens]) - self.lengths[tokens]
            owner = np.searchsorted(starts, at, "right") - 1
            if span >= most:
                return tokens, np.bincount(owner, minlength=len(strings))
            place = (at - starts[owner]) % (2 * span)
            edges = np.append(np.flatnonzero(place == 0), len(tokens))
            middle = np.flatnonzero(place == span)
            after = np.searchsorted(edges, middle)
            tokens = self._join_all(tokens, edges[after - 1], middle, edges[after])
            span *= 2

    def again(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """The tokens of these tokens' bytes, merged from single bytes."""
        known = self.windows.get(tokens) if len(tokens) <= FEW else None
        if known is not None:
            return known
        data = b"".join([self.bytes_of[t] for t in tokens])
        out = self.closed.get(data)
        if out is None:
            parts = merged([data[k : k + 1] for k in range(len(data))], self.rank_of)
            out = tuple([self.rank_of[p] for p in parts])
            if len(out) == 1:
                self.closed[data] = out
        if len(tokens) <= FEW:
            if len(self.windows) >= REMEMBERED:
                self.windows.clear()
            self.windows[tokens] = out
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The tokens of two strings in a row, from the tokens of each."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            window = left[len(left) - i :] + right[:j]
            new = self.again(window)
            left_stands = i == len(left) or new[0] == window[0]
            right_stands = j == len(right) or new[-1] == window[-1]
            if left_stands and right_stands:
                return left[: len(left) - i] + new + right[j:]
            if not left_stands:
                i = min(2 * i, len(left))
            if not right_stands:
                j = min(2 * j, len(right))

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The tokens of a byte string, by halves."""
        if len(data) < 2:
            return (self.rank_of[data],) if data else ()
        known = self.closed.get(data) or self.halves.get(data)
        if known is not None:
            return known
        middle = len(data) // 2
        out = self.join(self.encode(data[:middle]), self.encode(data[middle:]))
        if len(data) <= SHORT:
            if len(self.halves) >= REMEMBERED:
                self.halves.clear()
            self.halves[data] = out
        return out

    def wholes_of(self, matches: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each match of the pattern."""
        out = [self.wholes.get(m) for m in matches]
        unseen = [k for k, known in enumerate(out) if known is None]
        together = []
        for k in unseen:
            if (rank := self.rank_of.get(matches[k])) is not None:
                out[k] = (rank,)
            elif len(matches[k]) > LONG:
                out[k] = self.encode(matches[k])
            else:
                together.append(k)
        tokens, counts = self.encode_side_by_side([matches[k] for k in together])
        tokens, ends = tokens.tolist(), np.cumsum(counts).tolist()
        for k, a, b in zip(together, [0, *ends], ends):
            out[k] = tuple(tokens[a:b])
        if len(self.wholes) + len(unseen) > REMEMBERED:
            self.wholes.clear()
        self.wholes.update((matches[k], out[k]) for k in unseen[:REMEMBERED])
        return out

    def matches(self, text: str) -> list[str]:
        if text.isascii() or not self.is_stranger[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.as_symbols))]

    def cut(self, text: str) -> Iterator[list[str]]:
        """The matches in a text, a piece of it at a time.

        The last two matches of a piece that isn't the text's end may come out otherwise
        when more characters follow (a run goes on, an ending of three characters), so
        the next piece begins with them.
        """
        at, size = 0, CUT_CHARS
        while len(text) - at > size:
            found = self.matches(text[at : at + size])
            if len(found) < 3:
                size *= 2
                continue
            del found[-2:]
            at += sum(map(len, found))
            yield found
        yield self.matches(text[at:] if at else text)

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        ids, counts = self._ids([self.matches(t) if len(t) <= CUT_CHARS else [] for t in texts])
        long_ = [k for k, t in enumerate(texts) if len(t) > CUT_CHARS]
        if not long_:
            return _lists(counts, ids)
        out = np.split(ids, np.cumsum(counts)[:-1])
        for k in long_:
            out[k] = np.concatenate([self._ids([found])[0] for found in self.cut(texts[k])])
        return _lists(np.array([len(x) for x in out]), np.concatenate(out))

    def _ids(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches in a row, and their number for each list of matches."""
        per_list = np.array([len(x) for x in found], np.int64)
        coded = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = self.wholes_of(coded.dictionary.cast(pa.large_binary()).to_pylist())
        sizes = np.array([len(d) for d in distinct], np.int64)
        begins = np.cumsum(sizes) - sizes
        flat = np.fromiter(chain.from_iterable(distinct), np.int32, int(sizes.sum()))
        counts = sizes[codes]
        before = np.append(0, np.cumsum(counts))
        last = np.cumsum(per_list)
        return flat[_spans(begins[codes], counts)], before[last] - before[last - per_list]

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids: neighbours joined level by level, all lists side by side."""
        ids = ids.fill_null([])
        nodes = self.table.take(ids.flatten())
        counts = ids.value_lengths().to_numpy().astype(np.int64)
        while len(counts) and counts.max() > 1:
            begins = np.cumsum(counts) - counts
            joined = (counts + 1) // 2
            within = np.arange(joined.sum()) - np.repeat(np.cumsum(joined) - joined, joined)
            left = np.repeat(begins, joined) + 2 * within
            alone = 2 * within + 1 == np.repeat(counts, joined)
            right = pa.array(left + 1, mask=alone)
            nodes = pc.binary_join_element_wise(
                nodes.take(pa.array(left)), nodes.take(right), pa.scalar(b"", pa.large_binary()),
                null_handling="replace", null_replacement="",
            )
            counts = joined
        begins = np.cumsum(counts) - counts
        return pc.fill_null(nodes.take(pa.array(begins, mask=counts == 0)), b"")


def newer_characters() -> str:
    """Letters and numbers of the ``regex`` library that tiktoken's Unicode tables don't know yet."""
    import regex
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding("characters", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
        out |= set(regex.findall(kind, everything)) - set(library.decode(library.encode_ordinary(everything)))
    return "".join(sorted(out))


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size says, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(counts: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32()))


def encode_bytes(
    docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, and the ids with the decoded bytes.

    ``ranks`` is the vocabulary file and ``pattern`` cuts the texts; every character must lie in
    a match. With ``digests`` the ids and the bytes are replaced by the SHA-256 of the ids
    joined by commas and of the bytes, so that neither leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Ranks(ranks, pattern, strangers)
        for batch in slices(batches, 1, SLICE_BYTES):
            ids = vocabulary.encode_all(pc.fill_null(batch.column(1), "").to_pylist())
            decoded = vocabulary.decode_all(ids)
            columns = [batch.column(0), ids.value_lengths().cast(pa.int64())]
            if digests:
                joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), ",")
                columns += [_sha256(joined), _sha256(decoded)]
            else:
                columns += [ids, decoded.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    strangers = newer_characters()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    schema = f"doc_id {kind}, n_tokens bigint, {rest}"
    names = [c.split()[0] for c in schema.split(", ")]
    return source.mapInArrow(run, schema)


def decode_bytes(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that each row's ids stand for; NULL ids give no bytes. Other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Ranks(ranks, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, vocabulary.decode_all(column).cast(pa.binary())], names=[*batch.schema.names, name]
            )

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())]))


def _sha256(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())
