"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A segment's symbols start as its characters. Its agenda holds the cost (the negated piece
score) of every adjacent pair that forms a piece; the best pair, the leftmost of equals, is
merged and its new neighbours are put on the agenda, until the agenda is empty. The agendas
of a batch's distinct segments lie side by side in arrays, and each step takes the best
pair of every one; long segments have a heap of their own. Characters without a piece
become byte pieces.

No piece has a word mark after another character, so no merge crosses such a place, and a
text's ids are those of its segments in a row.

Every distinct segment of an Arrow batch is compared with the library, and so is one whole
text of the batch; ``agrees`` says whether the comparisons that concern a text held.
Decoding is the library's.

Defined cases: a NULL or empty text has no ids and decodes to an empty text. A word mark
in the text stands for a blank, as in the library. Repeated rows are encoded one by one.
Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilect.llm.shared import lean, slices

MARK = "▁"
#: Segments with more symbols get a heap.
SIDE_BY_SIDE = 64
#: Text bytes that are encoded at a time.
SLICE_BYTES = 1 << 20


class Pieces:
    """A vocabulary read from a model file through the library."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        usable = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in usable}
        self.cost_of = {p: -lib.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.byte_ids = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark inside; texts can't be cut into segments")
        self.characters = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.characters[ord(p)] = i
        pairs = [
            (self.ids[p[:k]] * size + self.ids[p[k:]], i, self.cost_of[p])
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        ]
        pairs.sort()
        self.size = size
        self.pair_keys = np.array([k for k, _, _ in pairs] or [-1], np.int64)
        self.pair_ids = np.array([i for _, i, _ in pairs] or [0], np.int32)
        self.pair_costs = np.array([c for _, _, c in pairs] or [np.inf])

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols the cost of merging them, infinite if they form no piece, and the piece."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_costs[at], np.inf), self.pair_ids[at]

    def encode_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and where each segment's ids begin (with the end)."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        symbols = self.characters[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(segments)), lengths)
        apart = lengths > SIDE_BY_SIDE
        apart[owner[symbols < 0]] = True
        kept = ~apart[owner]
        found = list(self._side_by_side(symbols[kept], owner[kept]))
        for k in np.flatnonzero(apart):
            ids = self.segment(segments[k])
            found.append((np.array(ids, np.int32), np.full(len(ids), k)))
        ids = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int32)
        owner = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(segments) + 1))

    def _side_by_side(self, symbols: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs the agendas of all segments in step; yields finished segments' symbols and owners."""
        if not len(symbols):
            return
        agenda, piece = self._look_up(symbols, np.append(symbols[1:], 0))
        agenda[np.append(owner[1:] != owner[:-1], True)] = np.inf
        while len(symbols):
            first = np.append(True, owner[1:] != owner[:-1])
            begins = np.flatnonzero(first)
            best = np.minimum.reduceat(agenda, begins)
            local = np.cumsum(first) - 1
            open_ = (best < np.inf)[local]
            if not open_.all():
                yield symbols[~open_], owner[~open_]
                symbols, owner, agenda, piece, best_here = (x[open_] for x in (symbols, owner, agenda, piece, best[local]))
            else:
                best_here = best[local]
            if not len(symbols):
                return
            at = np.flatnonzero(agenda == best_here)
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])]  # the leftmost of each segment
            symbols[at] = piece[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, owner, agenda, piece = (x[stays] for x in (symbols, owner, agenda, piece))
            at = at - np.arange(len(at))
            last = len(symbols) - 1
            for k in (at, at[at > 0] - 1):
                after = np.minimum(k + 1, last)
                cost, merged = self._look_up(symbols[k], symbols[after])
                cost[(owner[k] != owner[after]) | (after == k)] = np.inf
                agenda[k], piece[k] = cost, merged

    def segment(self, text: str) -> list[int]:
        """The ids of one segment, by a heap; pairs whose symbols were merged meanwhile are skipped."""
        cost_of, symbols, n = self.cost_of.get, list(text), len(text)
        costs = [cost_of(a + b) for a, b in zip(symbols, symbols[1:])]
        agenda = [(cost, k, 2) for k, cost in enumerate(costs) if cost is not None]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(agenda)
        while agenda:
            _, k, length = heapq.heappop(agenda)
            left, j = symbols[k], after[k]
            if not left or j >= n or len(left) + len(symbols[j]) != length:
                continue
            left = symbols[k] = left + symbols[j]
            symbols[j] = ""
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if (cost := cost_of(left + symbols[j])) is not None:
                    heapq.heappush(agenda, (cost, k, length + len(symbols[j])))
            i = before[k]
            if i >= 0 and (cost := cost_of(symbols[i] + left)) is not None:
                heapq.heappush(agenda, (cost, i, len(symbols[i]) + length))
        out: list[int] = []
        for s in filter(None, symbols):
            known = self.ids.get(s)
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out


def _one_blank_apart(text: str) -> str:
    """Blanks beyond one between words, and all at the start, as marks of the segment that follows."""
    text = re.sub(r"\A +", lambda m: MARK * len(m[0]), text)
    return re.sub("  +", lambda m: " " + MARK * (len(m[0]) - 1), text)


def cut(texts: pa.Array) -> pa.ListArray:
    """Each text's segments without their first mark; an empty text has one empty segment."""
    texts = pc.replace_substring(texts, MARK, " ")
    odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
    if pc.any(odd).as_py():
        texts = pc.replace_with_mask(texts, odd, pa.array(list(map(_one_blank_apart, texts.filter(odd).to_pylist())), texts.type))
    return pc.split_pattern(texts, " ")


def encode_batch(pieces: Pieces, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """The ids of each text, and whether the library agrees."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    parts = cut(texts)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    segments = coded.dictionary.to_pylist()
    flat, begins = pieces.encode_all([MARK + s for s in segments])
    theirs = pieces.library.encode([s.replace(MARK, " ") for s in segments], num_threads=1)
    doubted = _differences(segments, flat, begins, theirs)
    counts = np.diff(begins)[codes]
    of_part = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    counts[empty[of_part]] = 0
    ends = np.cumsum(counts)
    ids = flat[np.repeat(begins[:-1][codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
    per_text = np.bincount(of_part, weights=counts, minlength=len(texts)).astype(np.int64)
    out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_text)), pa.int32()), pa.array(ids, pa.int32()))
    agrees = np.ones(len(texts), bool)
    agrees[of_part[doubted[codes] & ~empty[of_part]]] = False
    if len(texts):
        k = len(texts) // 2
        agrees[k] &= out[k].as_py() == pieces.library.encode(texts[k].as_py())
    return out, pa.array(agrees)


def _differences(segments: list[str], flat: np.ndarray, begins: np.ndarray, theirs: list[list[int]]) -> np.ndarray:
    """Which segments the library encodes otherwise; it has no ids for an empty text, a lone mark here."""
    sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
    own = np.diff(begins)
    differ = sizes != own
    joined = np.fromiter((i for t in theirs for i in t), np.int32, int(sizes.sum()))
    same_size = ~differ
    ours = flat[np.repeat(same_size, own)]
    lib = joined[np.repeat(same_size, sizes)]
    owner = np.repeat(np.flatnonzero(same_size), own[same_size])
    differ[owner[ours != lib]] = True
    differ[[k for k, s in enumerate(segments) if not s]] = False
    return differ


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, agrees, and the ids with the decoded text.

    With ``digests`` the ids and the decoded text are replaced by the SHA-256 of the ids
    joined by commas and of the text in UTF-8, so that neither leaves the task.
    """

    def sha(values) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in slices(batches, 1, SLICE_BYTES):
            ids, agrees = encode_batch(pieces, batch.column(1))
            begins, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            decoded = [pieces.library.decode(flat[a:b].tolist()) for a, b in zip(begins, begins[1:])]
            columns = [batch.column(0), ids.value_lengths().cast(pa.int64()), agrees]
            if digests:
                texts = pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string()))
                columns += [sha(t.as_buffer() for t in pc.binary_join(texts, ",")), sha(d.encode() for d in decoded)]
            else:
                columns += [ids, pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = f"doc_id {kind}, n_tokens bigint, agrees boolean, {rest}"
    names = [c.split()[0] for c in schema.split(", ")]
    return source.mapInArrow(lambda b: lean(run(b)), schema)
