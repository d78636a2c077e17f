"""Jaccard self-join of n-gram sets by PartEnum signatures.

Two sets that are similar enough differ in few features, the fewer the smaller they are.
Sizes are cut into bands such that similar sets lie in one band or in two neighbouring
ones. For every such pair of bands the feature domain is partitioned by a hash into first-
level parts, so many that one of them holds at most one difference; that part is cut into
three, of which two must then agree. Each choice of a part and of two of its thirds is a
signature, and similar sets share at least one.

Texts with equal sets are one node. Signatures travel packed, by bucket; what comes out are
groups of nodes that share one. Within a group, pairs are sifted by size and by a parity
sketch, whose differing bits never outnumber the differing features, and a spanning forest
of what passes is verified on the texts' words. Pairs between groups' parts that are still
apart are then verified all. Components, not pairs, are the result.

Defined cases: a NULL or blank text has an empty set, links with nothing and is its own
component. A text with fewer words than a shingle has one, its whole sequence. Rows with a
NULL doc_id link with nothing and have no component. Repeated rows are equal sets; rows
that repeat a doc_id with other texts are judged by their texts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.llm.components import components
from trilect.llm.hashing import mix, sums_by
from trilect.llm.shared import lean, lean_table, parts_for, release, slices, text_of
from trilect.operators.ordering import checked_broadcast
from trilect.session import cut, scratch, store, store_folder

SLICE_BYTES = 4 << 20
#: Signatures in a bucket, members of a group that are compared in one block, and members of
#: all groups that are compared in one task.
BUCKET, BLOCK, TASK = 1 << 18, 2048, 1 << 15
#: Bits of a sketch: the power of two from one per feature on, and no fewer than these.
SKETCH_BITS = 512


class Threshold:
    """Similarity of at least ``num`` / ``den`` and what follows from it for sizes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        uppers = [1]
        while uppers[-1] < 1 << 34:
            uppers.append(max(uppers[-1] + 1, (uppers[-1] + 1) * den // num))
        self.uppers = np.array(uppers)

    def differences(self, sizes: np.ndarray) -> np.ndarray:
        """The most differences of a similar pair with sizes that add up to ``sizes``."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def similar(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def instances(self, size: int) -> list[tuple[int, int]]:
        """The (number, first-level parts) of the two band pairs that a set takes part in.

        A band pair whose sets may not differ at all needs no signatures: equal sets are one node.
        """
        band = int(np.searchsorted(self.uppers, size))
        found = []
        for j in (band, band + 1):
            k = int(self.differences(2 * self.uppers[j]))
            if k:
                found.append((j, (k + 2) // 2))
        return found


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text."""
    import xxhash

    number: dict[bytes, int] = {}
    words: list[int] = []
    ends = []
    for t in texts:
        for w in t.encode().lower().split():
            words.append(number.setdefault(w, len(number)))
        ends.append(len(words))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    each = hashes[np.array(words, np.int64)] if words else np.zeros(0, np.uint64)
    begin = 0
    for end in ends:
        own = each[begin:end]
        begin = end
        if len(own) >= width:
            acc = np.zeros(len(own) - width + 1, np.uint64)
            for k in range(width):
                acc = mix(acc + own[k : len(own) - width + 1 + k], k + 1)
            yield np.unique(acc)
        elif len(own):
            acc = np.full(1, 1000 + len(own), np.uint64)
            for k in range(len(own)):
                acc = mix(acc + own[k : k + 1], k + 1)
            yield acc
        else:
            yield np.zeros(0, np.uint64)


def node_of(features: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    parts = [np.add.reduce(mix(features, salt), dtype=np.uint64) for salt in (11, 12)]
    return b"".join(int(p).to_bytes(8, "big") for p in parts)


def sketch_of(features: np.ndarray) -> bytes:
    """For every bit whether an odd number of features falls on it."""
    bits = max(SKETCH_BITS, 1 << (len(features) - 1).bit_length())
    place = (mix(features, 13) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(bool)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of ``size`` bytes or more at that size, as rows of numbers: halves are added bit by bit."""
    rows = [np.frombuffer(s, np.uint64).reshape(-1, size // 8) for s in sketches]
    return np.stack([r[0] if len(r) == 1 else np.bitwise_xor.reduce(r, axis=0) for r in rows])


def signatures(features: np.ndarray, threshold: Threshold) -> np.ndarray:
    """The PartEnum signatures of one set."""
    found = []
    for j, parts in threshold.instances(len(features)):
        cells = (mix(features, 1000 + j) % np.uint64(3 * parts)).astype(np.int64)
        of_cell = sums_by(cells, mix(features, 14), 3 * parts).reshape(parts, 3)
        name = (np.arange(parts, dtype=np.uint64) << np.uint64(32)) + np.uint64(j)
        for omitted in range(3):
            a, b = (of_cell[:, c] for c in range(3) if c != omitted)
            found.append(mix(mix(mix(name, omitted + 21) + a, 31) + b, 32))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Per row doc_id, n_shingles, node and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            sets = list(shingle_sets(batch.column(1).to_pylist(), width))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "of_text": batch.column(2),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                "sketch": pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary()),
            })

    return docs.mapInArrow(lambda b: lean(run(b)), "doc_id bigint, of_text bigint, n_shingles bigint, node binary, sketch binary")


def short(node: bytes | Column) -> Column:
    """The first half of a node as a number, which may rarely stand for two nodes."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("bigint")


def packed_signatures(docs: DataFrame, width: int, threshold: Threshold, buckets: int) -> DataFrame:
    """(bucket, signatures, nodes, counts): per slice of texts and bucket the signatures of its distinct sets.

    Nodes are their first halves; a node's signatures follow one another, ``counts`` of them. Of a
    signature four bytes travel; what agrees in them by chance is one more group to sift.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            nodes, found = [], []
            seen: set[bytes] = set()
            for features in shingle_sets(batch.column(1).to_pylist(), width):
                if len(features) and (node := node_of(features)) not in seen:
                    seen.add(node)
                    nodes.append(int.from_bytes(node[:8], "big", signed=True))
                    found.append(signatures(features, threshold))
            if not any(map(len, found)):  # the smallest sets have no signatures
                continue
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            each = np.concatenate(found)
            bucket = (each % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            owner, each, bucket = owner[order], each[order], bucket[order]
            rows = []
            names = np.array(nodes, np.int64)
            begins = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                a, b = begins[k], begins[k + 1]
                if b > a:
                    own, counts = np.unique(owner[a:b], return_counts=True)
                    low = (each[a:b] // np.uint64(buckets)).astype(np.uint32)
                    rows.append((k, low.tobytes(), names[own].tobytes(), counts.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

    columns = ["bucket", "signatures", "nodes", "counts"]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return docs.mapInArrow(lambda b: lean(run(b)), "bucket int, signatures binary, nodes binary, counts binary")


def shared_groups(table: pa.Table) -> pa.Table:
    """Of one bucket the groups of nodes with a common signature: (gid, member), each group once."""
    signatures_, members = [], []
    for s, n, c in zip(*(table[x].to_pylist() for x in ("signatures", "nodes", "counts"))):
        signatures_.append(np.frombuffer(s, np.uint32))
        members.append(np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, np.uint32)))
    s, m = np.concatenate(signatures_), np.concatenate(members)
    order = np.lexsort((m, s))
    s, m = s[order], m[order]
    fresh = np.append(True, (s[1:] != s[:-1]) | (m[1:] != m[:-1]))
    s, m = s[fresh], m[fresh]
    first = np.append(True, s[1:] != s[:-1])
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    shared = size[group] > 1
    s, m, group = s[shared], m[shared], group[shared]
    if not len(s):
        return pa.table({"gid": pa.array([], pa.int64()), "member": pa.array([], pa.int64())})
    group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    gid = sums_by(group, mix(m.view(np.uint64), 41), group[-1] + 1)
    _, keep = np.unique(gid, return_index=True)
    chosen = np.isin(group, keep)
    return pa.table({"gid": pa.array(gid[group[chosen]].view(np.int64)), "member": pa.array(m[chosen])})


def _forest(adjacent, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``adjacent(k)`` tells which of the n nodes neighbour k."""
    left, edges = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        for k in queue:
            for j in np.flatnonzero(adjacent(k) & left):
                left[j] = False
                edges.append((k, int(j)))
                queue.append(int(j))
            if not left.any():
                break
    return edges


def likely_pairs(table: pa.Table, threshold: Threshold, everything: bool) -> pa.Table:
    """Of the groups of one task, pairs of nodes that may be similar and aren't in one component.

    A spanning forest of such pairs for each group, or all of them.
    """
    gid = table["gid"].to_numpy()
    order = np.argsort(gid, kind="stable")
    table = table.take(pa.array(order))
    gid = gid[order]
    raw = table["node"].to_pylist()
    size = table["n_shingles"].to_numpy()
    component = np.unique(np.array([c.hex() for c in table["root"].to_pylist()]), return_inverse=True)[1] if len(gid) else size
    sketches = table["sketch"].to_pylist()
    wide = np.fromiter(map(len, sketches), np.int64, len(sketches))
    begins = np.append(np.flatnonzero(np.append(True, gid[1:] != gid[:-1])), len(gid)) if len(gid) else np.zeros(1, int)

    def passing(i, j, apart: np.ndarray) -> np.ndarray:
        both = size[i] + size[j]
        most = threshold.differences(both)
        return (apart <= most) & (np.abs(size[i] - size[j]) <= most) & (component[i] != component[j])

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)

    found: list[tuple[int, int]] = []
    counts = np.diff(begins)
    twos = begins[:-1][counts == 2]
    narrow = np.minimum(wide[twos], wide[twos + 1]) if len(twos) else twos
    for bytes_ in np.unique(narrow).tolist():
        at = twos[narrow == bytes_]
        left, right = (folded([sketches[k] for k in x], bytes_) for x in (at, at + 1))
        found += [(int(k), int(k) + 1) for k in at[passing(at, at + 1, apart(left, right))]]
    for a, n in zip(begins[:-1][counts > 2].tolist(), counts[counts > 2].tolist()):
        here = folded(sketches[a : a + n], int(wide[a : a + n].min()))

        def near(k: int, here: np.ndarray = here, a: int = a, n: int = n) -> np.ndarray:
            return passing(a + k, slice(a, a + n), apart(here[k], here))

        if everything:
            found += [(a + k, a + int(j)) for k in range(n) for j in np.flatnonzero(near(k)) if j > k]
        else:
            found += [(a + i, a + j) for i, j in _forest(near, n)]
    pairs = {(min(raw[i], raw[j]), max(raw[i], raw[j])) for i, j in found}
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})


def comparer(threshold: Threshold, everything: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda groups: lean_table(likely_pairs(groups, threshold, everything))


def verify(pairs: DataFrame, texts: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """The (a, b) pairs with whether their texts' shingle sets are similar, compared word by word."""

    def shingles(text: str) -> set:
        w = text.encode().lower().split()
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, own, verdicts = None, set(), []
            for name, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if name != last:
                    last, own = name, shingles(a)
                other = shingles(b)
                verdicts.append(threshold.similar(len(own & other), len(own), len(other)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], names=["a", "b", "similar"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: lean(run(b)), "a binary, b binary, similar boolean")


def ngram_join(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the smallest doc_id reachable by links; ``of_text`` is a hash of the text."""
    threshold = Threshold(num, den)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    named = source.filter(F.col("doc_id").isNotNull())
    rows = store(describe(source.withColumn("of_text", F.xxhash64("text")), width))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # About a third of a signature for every shingle at 0.9; more at lower thresholds.
    buckets = max(partitions, parts_for(3 * total * (den - num), BUCKET * den))
    nodes = store(
        rows.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
        .withColumn("member", short(F.col("node")))
    )
    groups = store(
        packed_signatures(named, width, threshold, buckets)
        .groupBy("bucket")
        .applyInArrow(lambda t: lean_table(shared_groups(t)), "gid bigint, member bigint")
        .distinct()
    )
    release(docs.sparkSession)
    # A group beyond a block is compared block by block.
    sizes = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    large = cut(sizes.filter("blocks > 1").select("gid", "blocks"))
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        groups.join(checked_broadcast(large), "gid", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", other)
        .select(F.xxhash64("gid", F.least("block", "other"), F.greatest("block", "other")).alias("gid"), "member")
    )
    met = store(dealt.join(nodes.select("member", "node", "n_shingles", "sketch"), "member").drop("member"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """node and text of the nodes of the pairs."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = cut(wanted.join(nodes.select("node", "doc_id"), "node").select("doc_id"))
        taken = named.join(checked_broadcast(ids), "doc_id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, SLICE_BYTES):
                sets = shingle_sets(batch.column(1).to_pylist(), width)
                names = pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([names, batch.column(1)], names=["node", "text"])

        return taken.mapInArrow(lambda b: lean(run(b)), "node binary, text string").dropDuplicates(["node"])

    tasks = max(partitions, parts_for(met.count(), TASK))
    roots, refuted, linked = None, None, None
    for everything in (False, True):
        state = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        task = F.pmod(F.xxhash64("gid"), F.lit(tasks)).alias("task")
        found = (
            state.select(task, "gid", "node", "n_shingles", "sketch", "root")
            .groupBy("task")
            .applyInArrow(comparer(threshold, everything), "a binary, b binary")
            .distinct()
        )
        if refuted is not None:
            found = found.join(refuted, ["a", "b"], "left_anti")
        pairs = store(found)
        if pairs.isEmpty():
            break
        judged = store(verify(pairs, store(texts_of(pairs)), width, threshold))
        refuted = judged.filter(~F.col("similar")).select("a", "b")
        links = judged.filter("similar").select("a", "b")
        linked = links if linked is None else linked.unionByName(links)
        roots = cut(components(linked))
        release(docs.sparkSession)
    best = nodes.select("node", "doc_id")
    if roots is not None:
        grouped = best.join(roots, "node")
        least = grouped.groupBy("root").agg(F.min("doc_id").alias("least"))
        of_linked = grouped.join(least, "root").select("node", "least")
        best = best.join(of_linked, "node", "left").select("node", F.coalesce("least", "doc_id").alias("doc_id"))
    result = rows.select("doc_id", "n_shingles", "node", "of_text").join(best.withColumnRenamed("doc_id", "component_id"), "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", own.alias("component_id"), "of_text")


def one_per_component(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of ``docs`` for each component, whatever the ids: rows are told apart by doc_id and text.

    The row with the smallest doc_id stays (NULL comes last), then that with the least text
    hash. Rows that agree in doc_id and text are one; a blank text is its own component.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = rows.withColumns({"doc_id": F.col("_doc.doc_id").cast("bigint"), "of_text": F.xxhash64(text_of(F.col("_doc.text")))})
    rows = rows.withColumn("row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "of_text"))
    keys = rows.select("row", "doc_id", "of_text").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "of_text", "row", "n")).alias("least")
    place = store_folder(docs.sparkSession)
    with scratch(docs.sparkSession):  # later stages need the disk; only what stays is kept
        judged = ngram_join(rows.select("row", F.col("_doc.text").alias("text")), width, num, den, doc_id="row")
        members = judged.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
        stay = store(members.join(keys, "row").groupBy("component_id").agg(least).select("least.row", "least.n"), place)
    single = rows.join(checked_broadcast(stay.filter("n = 1").drop("n")), "row", "left_semi")
    several = rows.join(checked_broadcast(stay.filter("n > 1").drop("n")), "row", "left_semi")
    return single.unionByName(several.dropDuplicates(["row"])).select("_doc.*")
