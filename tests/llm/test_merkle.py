import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from conftest import SCHEMA, document
from pyspark.sql import functions as F

from trilect.llm import merkle
from trilect.llm.merkle import lower_ascii, manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(r, text):
    fields = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """The last node, and each node's siblings level by level."""
    beside, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p - p % 8 : p - p % 8 + 8]
            beside[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at[k] = p // 8
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], beside


def brute(rows, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, tampered(r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in names:
        groups[g].sort()
        tops[g] = climb([x[2] for x in groups[g]])
    root, above = climb([tops[g][0] for g in names])
    out = []
    for g, onward in zip(names, above):
        for (known, doc_id, own, found), path in zip(groups[g], tops[g][1]):
            path = path + onward
            folded = found
            for left, right in path:
                folded = h(left + folded + right)
            proof = [a + b for a, b in path]
            out.append((doc_id if known else None, own, tops[g][0], root, h("".join(proof)), folded, folded == root, proof))
    return out


def lowered(r):
    if r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3:
        return r.text
    return r.text.translate(LOWER)


def check(docs):
    met = F.when(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0), lower_ascii(F.col("text")))
    got = manifest(docs, F.coalesce(met, F.col("text")))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    assert got.columns == names
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(docs.collect(), lowered)))


def test_documents(documents):
    check(documents)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert manifest(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 73])
def test_sizes_around_a_full_run(spark, n):
    check(spark.createDataFrame([document(i, f"Text {i}", "a") for i in range(n)], SCHEMA))


def test_superblocks_of_superblocks(spark, monkeypatch):
    """With superblocks of eight nodes a group of 700 takes four rounds up."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rng = random.Random(1)
    rows = [document(rng.randrange(10**18), f"Text {i}", rng.choice(["a", "a", "a", "é", None, "Z" + str(i)])) for i in range(700)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_only_changed_rows_fail(make_docs):
    docs = make_docs([(1, "One"), (2, "two"), (3, "Three"), (4, None), (5, "")])
    got = manifest(docs, lower_ascii(F.col("text"))).where("NOT verified").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]
