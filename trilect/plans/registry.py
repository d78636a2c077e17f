"""Named queries over a table folder, each with its SQL statement for the differential check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from trilect.functions.dialect import DIALECTS
from trilect.session import configure
from trilect.sources.tables import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """The tables of one folder, read when first used."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.directory, name)

    def sql(self, text: str) -> DataFrame:
        """A derived input: SQL text with table names in braces."""
        used = {name: getattr(self, name) for name in TABLES if "{" + name + "}" in text}
        return self.spark.sql(text, **used)


def plain(text: str) -> str:
    """Derivation text as SQL over views named like the tables."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _run(build: Callable[[Tables], DataFrame], spark: SparkSession, directory: str) -> DataFrame:
    return build(Tables(configure(spark), directory))


def add(name: str, build: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is defined twice")
    QUERIES[name] = partial(_run, build)
    if oracle is not None:
        ORACLES[name] = oracle


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        add(name, build, oracle)
        return build

    return register


def per_dialect(name: str, oracles: dict[str, str] | str, dialects: tuple[str, ...] = DIALECTS):
    """One query per dialect; the builder takes (tables, dialect)."""

    def register(build: Callable[[Tables, str], DataFrame]):
        for d in dialects:
            sql = oracles if isinstance(oracles, str) else oracles[d]
            add(f"{name}_{d}", partial(_with_dialect, build, d), sql)
        return build

    return register


def _with_dialect(build: Callable[[Tables, str], DataFrame], dialect: str, tables: Tables) -> DataFrame:
    return build(tables, dialect)


def names() -> Iterator[str]:
    return iter(QUERIES)
