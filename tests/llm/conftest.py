import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()

#: The columns of documents and others whose names operators use themselves.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size int, score double, "
    "n_words string, component_id string, label string, bucket string, part string, node string, word string, c int, place int"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def document(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, 0.5, "y", "z", "l", "b", "p", "n", "w", 7, 8)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    rows = [
        document(1, None),
        document(2, ""),
        document(3, " \t\n\x0b "),
        document(None, prose(1, 80)),
        document(4, prose(1, 80)),
        document(5, prose(1, 80), None, None),
        document(5, prose(1, 80), None, None),
        document(6, prose(2, 30_000), "fr", "t"),
        document(7, "one"),
        document(8, "One"),
        document(9, "ÉTÉ 日本 😀 \x00 ▁x  y"),
        document(10, prose(3, 120), None, ""),
        document(10, prose(4, 120), "de", ""),
        document(11, "word " * 300),
        tuple([None] * 17),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(pairs):
        return spark.createDataFrame([document(i, t) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


def same_schema(a: T.StructType, b: T.StructType) -> bool:
    return [(f.name, f.dataType) for f in a] == [(f.name, f.dataType) for f in b]
