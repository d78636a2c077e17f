"""Removal of passages that an earlier document has too, by sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a
smaller doc_id. Strings are dealt out by content: the least hash of a string's ``K``-byte
pieces is its anchor, equal strings have equal anchors, and neighbouring strings mostly
share theirs, so a run of strings with one anchor travels as one segment of bytes.

1. Which anchors occur under two doc_ids or more: packed hashes meet by bucket, and each
   document learns which of its own are among them.
2. Documents send the segments of those anchors to the anchor's bucket, equal segments of
   a part once, for the smallest doc_id. There equal segments are settled at once, and the
   suffixes of the others are sorted; runs of equal suffixes give the smallest doc_id of
   each string. What is covered goes back to the documents.
   The strings of an anchor that very many documents have are dealt out one by one, each by
   its own content, so that their number never meets in one bucket.
3. Each document takes the union of what is covered out of its text.

Texts travel compressed and by document part; no step needs more than one part or bucket
at a time, and however many documents share a passage, a bucket gets it once from a part.

Defined cases: a NULL text is an empty one; texts of fewer bytes than ``LENGTH`` keep all.
Rows with a NULL doc_id neither lose nor cover anything. Rows with the same doc_id don't
cover one another. Strings are judged on the input, whatever is removed elsewhere. Only
the named and the carried columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trilect.llm.hashing import mix
from trilect.llm.shared import lean, lean_table, parts_for, slices, text_of
from trilect.llm.suffix_sort import sort_suffixes
from trilect.operators.ordering import checked_broadcast, null_safe_join, positions
from trilect.session import store

LENGTH, K = 50, 20
SLICE_BYTES = 8 << 20
#: Text bytes that are hashed at a time, so that short texts share the calls and all stays near the core.
BLOCK_BYTES = 32 << 10
#: Text bytes per document part, per bucket of anchors and per bucket of segments.
PART, ANCHOR_BUCKET, SEGMENT_BUCKET = 16 << 20, 16 << 20, 4 << 20
#: Segments that are held one by one before they are packed.
PIECES = 1 << 16
#: Documents beyond which an anchor's strings are dealt out one by one instead of as segments.
FREQUENT = 2048


def piece_hashes(text: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of the k bytes from each place on, put together from halves."""
    step, width, power = text.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x100000001B3)
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if out is None:
                    out = step
                else:
                    n = len(step) - done
                    out = out[:n] * power + step[done : done + n]
                done += width
            if width * 2 > k:
                break
            step = step[:-width] * power + step[width:]
            power, width = power * power, width * 2
    return mix(out[: len(text) - k + 1], 5)


def anchors(text: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """The anchor of the string of ``length`` bytes at each place."""
    least, wide, width = piece_hashes(text, k), length - k + 1, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (wide - width)], least[wide - width :]) if width < wide else least


def _bytes(text: bytes | str) -> np.ndarray:
    return np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8)


def _anchored(rows: Iterable[tuple]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each row, whose last value is a text of ``LENGTH`` bytes or more, with the anchors of the text.

    Several texts are hashed at a time: a string lies in one of them, whatever follows it.
    """
    held, size = [], 0
    for row in chain(rows, [None]):
        if held and (row is None or size + len(row[-1]) > BLOCK_BYTES):
            joined, at = anchors(_bytes(b"".join(r[-1] for r in held))), 0
            for r in held:
                yield r, joined[at : at + len(r[-1]) - LENGTH + 1]
                at += len(r[-1])
            held, size = [], 0
        if row is not None:
            held.append(row)
            size += len(row[-1])


def _parts_of(doc_ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc_ids.astype(np.int64).view(np.uint64), 6) % np.uint64(parts)).astype(np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, with their lengths, in one compressed block."""
    import zstandard

    head = np.array([len(a.tobytes()) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(block: bytes, *types: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = np.frombuffer(raw, np.int64, len(types))
    ends = 8 * len(types) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], t) for s, e, t in zip(sizes, ends, types)]


def _split(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each key below n that occurs the places where it does, in order."""
    order = np.argsort(key, kind="stable")
    begins = np.searchsorted(key[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(begins)):
        yield int(k), order[begins[k] : begins[k + 1]]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted array each value with where its run begins and ends."""
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begins], begins, np.append(begins[1:], len(key))


def _offsets(texts: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _spelled(texts: pa.LargeBinaryArray) -> np.ndarray:
    """All bytes of the texts, one text after the other."""
    ends, held = _offsets(texts), texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def _packed_rows(rows: list[tuple[int, bytes]], name: str) -> pa.Table:
    return pa.table({name: pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})


def _send_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, SLICE_BYTES):
        hashes, owners = [], []
        rows = ((i, text.encode()) for i, text in zip(*(c.to_pylist() for c in batch.columns[:2])))
        for (i, _), anchor in _anchored(rows):
            own = np.sort(anchor[np.append(True, anchor[1:] != anchor[:-1])])
            own = own[np.append(True, own[1:] != own[:-1])]
            hashes.append(own)
            owners.append(np.full(len(own), i, np.int64))
        if not hashes:
            continue
        each, owner = np.concatenate(hashes), np.concatenate(owners)
        rows = []
        for k, at in _split((each % np.uint64(buckets)).astype(np.int64), buckets):
            # Documents follow one another, so an id and the number of its hashes are enough.
            change = np.flatnonzero(np.append(True, owner[at][1:] != owner[at][:-1]))
            low = (each[at] // np.uint64(buckets)).astype(np.uint32)
            rows.append((k, _pack(low, owner[at][change], np.diff(np.append(change, len(at))).astype(np.uint32))))
        yield from _packed_rows(rows, "bucket").to_batches()


def _shared_anchors(table: pa.Table, parts: int) -> pa.Table:
    """For the documents of each part the low bits of those of their anchors that others have too."""
    if not table.num_rows:
        return _packed_rows([], "part")
    bucket = table["bucket"][0].as_py()
    hashes, owners = [], []
    for block in table["packed"].to_pylist():
        low, ids, counts = _unpack(block, np.uint32, np.int64, np.uint32)
        hashes.append(low)
        owners.append(np.repeat(ids, counts))
    each, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(each, kind="stable")
    each, owner = each[order], owner[order]
    begins = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
    several = np.minimum.reduceat(owner, begins) < np.maximum.reduceat(owner, begins)
    sizes = np.diff(np.append(begins, len(each)))
    kept = np.repeat(several, sizes)
    frequent = np.repeat(sizes > FREQUENT, sizes)[kept].astype(np.uint8)
    each, owner = each[kept], owner[kept]
    rows = []
    for part, at in _split(_parts_of(owner, parts), parts):
        at = at[np.argsort(owner[at], kind="stable")]
        change = np.flatnonzero(np.append(True, owner[at][1:] != owner[at][:-1]))
        counts = np.diff(np.append(change, len(at))).astype(np.uint32)
        rows.append((part, _pack(np.array([bucket], np.int64), each[at], frequent[at], owner[at][change], counts)))
    return _packed_rows(rows, "part")


def _send_segments(texts: pa.Table, shared: pa.Table, anchor_buckets: int, buckets: int) -> pa.Table:
    """Segments of the part's documents by bucket, and what equal segments of the part settle."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    names, owners, often = [], [], []
    for block in shared["packed"].to_pylist():
        bucket, low, flags, ids, counts = _unpack(block, np.int64, np.uint32, np.uint8, np.int64, np.uint32)
        often.append(flags)
        names.append(low.astype(np.uint64) * np.uint64(anchor_buckets) + np.uint64(bucket[0]))
        owners.append(np.repeat(ids, counts))
    if not names:
        return _packed_rows([], "bucket")
    # Four bytes are compared on both sides; what agrees by chance only costs a segment.
    wanted, owner, often = np.concatenate(names), np.concatenate(owners), np.concatenate(often)
    order = np.lexsort((wanted, owner))
    wanted, owner, often = wanted[order], owner[order], often[order]
    begins = {int(i): (a, b) for i, a, b in zip(*_runs(owner))}
    rows = zip(texts["doc_id"].to_pylist(), texts["of_text"].to_pylist(), texts["text"].to_pylist())
    low_bits = np.uint64((1 << 32) - 1)
    pieces: list[pa.Array] = []
    dealt, owners_, of_text, start = [], [], [], []  # of each segment what deals it out, and where it comes from
    spelled: list[bytes] = []
    opened = ((i, h, opener.decompress(t)) for i, h, t in sorted((r for r in rows if r[0] in begins), key=lambda r: r[:2]))
    for (i, h, text), anchor in _anchored(r for r in opened if len(r[-1]) >= LENGTH):
        a, b = begins[i]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], len(anchor))
        own = anchor[first]
        name = ((own // np.uint64(anchor_buckets)) & low_bits) * np.uint64(anchor_buckets) + own % np.uint64(anchor_buckets)
        at = np.minimum(np.searchsorted(wanted[a:b], name), b - a - 1)
        meets = wanted[a:b][at] == name
        single = often[a:b][at][meets] > 0
        begin, end, by = first[meets], last[meets] - 1 + LENGTH, own[meets]
        if single.any():
            # A frequent anchor's run becomes its single strings.
            strings = np.where(single, end - begin - LENGTH + 1, 1)
            run = np.repeat(np.arange(len(begin)), strings)
            inner = np.arange(len(run)) - np.repeat(np.cumsum(strings) - strings, strings)
            begin, end, by = begin[run] + inner, np.where(single[run], begin[run] + inner + LENGTH, end[run]), by[run]
            alone = np.flatnonzero(single[run])
            by[alone] = [zlib.crc32(text[s : s + LENGTH]) for s in begin[alone].tolist()]
        spelled += [text[s:e] for s, e in zip(begin.tolist(), end.tolist())]
        dealt.append(by)
        owners_.append(np.full(len(begin), i, np.int64))
        of_text.append(np.full(len(begin), h, np.int64))
        start.append(begin)
        if len(spelled) > PIECES:
            pieces.append(pa.array(spelled, pa.large_binary()))
            spelled = []
    pieces.append(pa.array(spelled, pa.large_binary()))
    if not sum(map(len, pieces)):
        return _packed_rows([], "bucket")
    coded = pa.chunked_array(pieces).combine_chunks().dictionary_encode()
    del pieces, spelled
    # Documents come by id: a segment belongs to the first that has it, and covers it in later ones.
    code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    dealt, owner, of_text, start = (np.concatenate(x) for x in (dealt, owners_, of_text, start))
    m = len(distinct)
    held = np.zeros(m, np.int64)
    held[code[::-1]] = np.arange(len(code))[::-1]
    holder = owner[held]
    piece_bucket = (mix(dealt[held], 7) % np.uint64(buckets)).astype(np.int64)
    sizes = np.diff(_offsets(distinct)).astype(np.uint32)
    entry = holder[code] == owner
    settled = np.column_stack([owner, of_text, start, start + sizes[code]])[~entry]
    settled_in = dict(_split(piece_bucket[code[~entry]], buckets))
    code, of_text, start = code[entry], of_text[entry], start[entry]
    entries_in = dict(_split(piece_bucket[code], buckets))
    none = np.zeros(0, np.int64)
    local = np.zeros(m, np.int64)
    out = []
    for k, at in _split(piece_bucket, buckets):
        local[at] = np.arange(len(at))
        e, c = entries_in[k], settled[settled_in.get(k, none)]
        out.append((k, _pack(_spelled(distinct.take(pa.array(at))), sizes[at], holder[at], local[code[e]], of_text[e], start[e], c.ravel())))
    return _packed_rows(out, "bucket")


def _covered(table: pa.Table, parts: int) -> pa.Table:
    """What is covered by smaller documents, by part: doc_id, text, begin and end in bytes."""
    texts, sizes, owners, which, of_text, start, settled = [], [], [], [], [], [], []
    n = 0
    for block in table["packed"].to_pylist():
        t, z, o, w, h, s, c = _unpack(block, np.uint8, np.uint32, np.int64, np.int64, np.int64, np.int64, np.int64)
        texts.append(t)
        sizes.append(z)
        owners.append(o)
        which.append(w + n)
        of_text.append(h)
        start.append(s)
        settled.append(c.reshape(-1, 4))
        n += len(z)
    if not n:
        return _packed_rows([], "part")
    text, size, owner = np.concatenate(texts), np.concatenate(sizes).astype(np.int64), np.concatenate(owners)
    which, of_text, start = np.concatenate(which), np.concatenate(of_text), np.concatenate(start)
    out = [np.concatenate(settled)]
    # Equal segments of several parts: all but the smallest document's are covered whole.
    offsets = np.append(0, np.cumsum(size))
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    coded = spelled.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    m = len(coded.dictionary)
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, code, owner)
    of = code[which]
    whole = owner[which] > least[of]
    out.append(np.column_stack([owner[which], of_text, start, start + size[which]])[whole])
    of, own, of_text, start = of[~whole], owner[which][~whole], of_text[~whole], start[~whole]
    # Strings of different segments can be equal only where the segments' anchors are.
    joined, offsets = _spelled(coded.dictionary), _offsets(coded.dictionary)
    begin, extent = offsets[:-1] - offsets[0], np.diff(offsets)
    hashes = piece_hashes(joined)
    hashes = np.append(hashes, np.full(K - 1, np.iinfo(np.uint64).max, np.uint64))
    inside = np.arange(len(joined)) - np.repeat(begin, extent) <= np.repeat(extent, extent) - K
    anchor = np.minimum.reduceat(np.where(inside, hashes, np.iinfo(np.uint64).max), begin)
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    several = members[group] > 1
    strings = np.where(several, extent - LENGTH + 1, 0)
    place = np.repeat(np.arange(m), strings)
    offset = np.arange(len(place)) - np.repeat(np.cumsum(strings) - strings, strings)
    starts = begin[place] + offset
    order, equal = sort_suffixes(joined, starts, LENGTH)
    if len(order):
        by_start = np.full(len(joined), -1, np.int64)
        by_start[starts] = place
        holder = least[by_start[order]]
        first = np.flatnonzero(~equal)
        smallest = np.repeat(np.minimum.reduceat(holder, first), np.diff(np.append(first, len(order))))
        hit = np.zeros(len(joined), bool)
        hit[order[smallest < holder]] = True
        hits = hit[starts]
        opens = np.flatnonzero(hits & ~(np.append(False, hits[:-1]) & np.append(False, place[1:] == place[:-1])))
        closes = np.flatnonzero(hits & ~(np.append(hits[1:], False) & np.append(place[1:] == place[:-1], False)))
        of_run, a, b = place[opens], offset[opens], offset[closes] + LENGTH
        low, high = np.searchsorted(of_run, of), np.searchsorted(of_run, of, side="right")
        each = high - low
        entry = np.repeat(np.arange(len(of)), each)
        run = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(len(entry))
        out.append(np.column_stack([own[entry], of_text[entry], start[entry] + a[run], start[entry] + b[run]]))
    found = np.concatenate(out)
    rows = [(part, _pack(np.ascontiguousarray(found[at]).ravel())) for part, at in _split(_parts_of(found[:, 0], parts), parts)]
    return _packed_rows(rows, "part")


def _remove(texts: pa.Table, covered: pa.Table, schema: pa.Schema) -> pa.Table:
    """The texts of a part without what is covered."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    found = [_unpack(b, np.int64)[0].reshape(-1, 4) for b in covered["packed"].to_pylist()]
    at = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    at = at[np.lexsort((at[:, 2], at[:, 1], at[:, 0]))]
    change = np.flatnonzero(np.append(True, (at[1:, :2] != at[:-1, :2]).any(1))) if len(at) else np.zeros(0, np.int64)
    of = {(int(at[a, 0]), int(at[a, 1])): at[a:b, 2:] for a, b in zip(change, np.append(change[1:], len(at)))}
    sizes, spans, kept = [], [], []
    for i, h, packed in zip(*(texts[c].to_pylist() for c in ("doc_id", "of_text", "text"))):
        text = opener.decompress(packed)
        runs: list[dict[str, int]] = []
        for a, b in of.get((i, h), np.zeros((0, 2), np.int64)).tolist():
            if runs and a <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], b)
            else:
                runs.append({"begin": a, "end": b})
        edges = [0, *(x for r in runs for x in (r["begin"], r["end"])), len(text)]
        sizes.append(len(text))
        spans.append(runs)
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
    if schema.field("kept").type == pa.string():
        kept = [k.decode(errors="ignore") for k in kept]
    own = {"n_bytes": sizes, "spans": spans, "kept": kept}
    return pa.table([pa.array(own[f.name], f.type) if f.name in own else texts[f.name].cast(f.type) for f in schema], schema=schema)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), as_text: bool = False
) -> DataFrame:
    """Per row doc_id, n_bytes, spans (begin and end of what was removed, in bytes) and kept, the bytes left.

    With ``as_text`` kept is a string, without the bytes of characters that a span cuts. Columns named in ``carry`` come along as ``_carried_0``, ``_carried_1`` and so on.
    """
    spark = docs.sparkSession
    carried = [F.col(f"`{c}`").alias(f"_carried_{k}") for k, c in enumerate(carry)]
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"), *carried)
    total = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, anchor_buckets, segment_buckets = (max(least, parts_for(total, s)) for s in (PART, ANCHOR_BUCKET, SEGMENT_BUCKET))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 1, SLICE_BYTES):
            ids = batch.column(0).fill_null(0).to_numpy()
            part = _parts_of(np.where(batch.column(0).is_null(), batch.column(2).to_numpy(), ids), parts)
            texts = pa.array([packer.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), batch.column(0), batch.column(2), texts, *batch.columns[3:]], names=["part", "doc_id", "of_text", "text", *extra]
            )

    extra = [f"_carried_{k}" for k in range(len(carry))]
    shape = source.select("doc_id", "text", F.xxhash64("text").alias("of_text"), *extra)
    kinds = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("of_text", T.LongType()),
        T.StructField("text", T.BinaryType()), *[source.schema[c] for c in extra],
    ])
    packed = shape.mapInArrow(lambda b: lean(compress(b)), kinds)
    long = source.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", "text")
    shared = (
        long.mapInArrow(lambda b: lean(_send_anchors(b, anchor_buckets)), "bucket int, packed binary")
        .groupBy("bucket")
        .applyInArrow(lambda t: lean_table(_shared_anchors(t, parts)), "part int, packed binary")
    )
    # All columns come along, so that one exchange of the texts serves both steps.
    segments = (
        packed.groupBy("part")
        .cogroup(shared.groupBy("part"))
        .applyInArrow(lambda t, s: lean_table(_send_segments(t, s, anchor_buckets, segment_buckets)), "bucket int, packed binary")
    )
    covered = segments.groupBy("bucket").applyInArrow(lambda t: lean_table(_covered(t, parts)), "part int, packed binary")
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    result = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", spans),
        T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *[source.schema[c] for c in extra],
    ])
    arrow = to_arrow_schema(result)
    return packed.groupBy("part").cogroup(covered.groupBy("part")).applyInArrow(lambda t, c: lean_table(_remove(t, c, arrow)), result)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number ``name`` for each doc_id and text, in the order of doc_id (NULL last) and text hash.

    Where every doc_id names one row, it is the number itself.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = rows.withColumns({"doc_id": F.col("_doc.doc_id").cast("bigint"), "of_text": F.xxhash64(text_of(F.col("_doc.text")))})
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return rows.select("_doc.*", F.col("doc_id").alias(name))
    keys = rows.select("doc_id", "of_text").distinct()
    places = store(positions(keys, [F.col("doc_id").asc_nulls_last(), "of_text"], name="place"))
    joined = null_safe_join(rows, checked_broadcast(places), ["doc_id", "of_text"])
    return joined.select("_doc.*", F.col("place").alias(name))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and ``n_chars`` counted anew.

    Rows that share a doc_id or have none are judged too: the smaller doc_id keeps a passage
    (NULL comes last), then the smaller text hash.
    """
    name = "_number"
    while name in docs.columns:
        name = f"_{name}"
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    done = remove_repeats(numbered(docs, name), doc_id=name, carry=rest, as_text=True)
    values = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    values |= {c: F.col(f"_carried_{k}") for k, c in enumerate(rest)}
    return done.select(*[values[c].alias(c) for c in docs.columns])
