"""Every registered query against its SQL statement on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from trilect.plans.registry import TABLES

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()
SPARK_TO_SQL = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return con


def _sorted(rows):
    return sorted(tuple(repr(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data_dir):
    df = QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert {c: SPARK_TO_SQL[t] for c, t in df.dtypes} == types
    place = [rel.columns.index(c) for c in columns]
    assert _sorted(got) == _sorted(tuple(r[i] for i in place) for r in rel.fetchall())


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.count() == 25 and "avg_log_salary" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

