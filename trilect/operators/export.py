"""Tables as INSERT scripts of the three dialects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.functions.literals import sql_literal
from trilect.operators.ordering import positions
from trilect.operators.relational import ordered_list

BATCH = 50


def _quote(name: str, dialect: str) -> str:
    return f"`{name}`" if dialect == "mysql" else f'"{name}"'


def case_insensitive_align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` out of ``df``: the exact name first, else a column that differs in case only, else NULL."""
    given = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(given))])

    def pick(name: str) -> Column:
        exact = [i for i, g in enumerate(given) if g == name]
        variants = [i for i, g in enumerate(given) if g != name and g.lower() == name.lower()]
        found = [F.col(f"_c{i}") for i in exact + variants]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return plain.select(*[pick(c).alias(c) for c in columns])


def value_tuple(df: DataFrame, dialect: str, declared: dict[str, str] | None = None) -> Column:
    """A row as ``(v1, v2, ..)``."""
    values = [sql_literal(F.col(f"`{f.name}`"), f.dataType, dialect, (declared or {}).get(f.name)) for f in df.schema.fields]
    return F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(")"))


def insert_statements(
    df: DataFrame,
    table: str,
    dialect: str,
    order: Sequence[str],
    declared: dict[str, str] | None = None,
    batch: int = BATCH,
) -> DataFrame:
    """(batch_no, statement): ``batch`` rows per INSERT for mysql and pg, one for oracle."""
    columns = ", ".join(_quote(c, dialect) for c in df.columns)
    head = f"INSERT INTO {_quote(table, dialect)} ({columns}) VALUES"
    numbered = positions(df, order, name="_n")
    rows = numbered.select("_n", value_tuple(df, dialect, declared).alias("_row"))
    if dialect == "oracle":
        return rows.select(
            (F.col("_n") - 1).alias("batch_no"), F.concat(F.lit(f"{head} "), F.col("_row"), F.lit(";")).alias("statement")
        )
    batched = rows.groupBy(F.floor((F.col("_n") - 1) / batch).alias("batch_no")).agg(
        ordered_list(F.concat(F.lit("  "), F.col("_row")), "_n", ",\n").alias("_rows")
    )
    return batched.select("batch_no", F.concat(F.lit(f"{head}\n"), F.col("_rows"), F.lit(";")).alias("statement"))


# Switches every foreign key of the schema; the word is ENABLE or DISABLE.
_ORACLE_SWITCH = """DECLARE
  CURSOR links IS SELECT owner, table_name, constraint_name FROM user_constraints WHERE constraint_type = 'R';
BEGIN
  FOR k IN links LOOP
    EXECUTE IMMEDIATE 'ALTER TABLE "' || k.owner || '"."' || k.table_name || '" {} CONSTRAINT "' || k.constraint_name || '"';
  END LOOP;
END;
/"""
# Statements around a script.
HEADER = {
    "mysql": ["SET NAMES utf8mb4;", "SET FOREIGN_KEY_CHECKS = 0;"],
    "pg": ["SET client_encoding = 'UTF8';"],
    "oracle": [_ORACLE_SWITCH.format("DISABLE")],
}
FOOTER = {
    "mysql": ["SET FOREIGN_KEY_CHECKS = 1;"],
    "pg": [],
    "oracle": [_ORACLE_SWITCH.format("ENABLE"), "COMMIT;"],
}
LAST_LEVEL = 1 << 30


def database_script(
    tables: dict[str, DataFrame],
    levels: dict[str, int],
    orders: dict[str, Sequence[str]],
    dialect: str,
    declared: dict[str, dict[str, str]] | None = None,
    auto_increment: dict[str, str] | None = None,
    title: str = "",
) -> DataFrame:
    """(level, table_name, section, batch_no, line): a whole script, parents before children.

    Sorting by the first four columns gives the script; ``sources.tables.write_sql_dump``
    writes it without bringing it to one place. Empty tables are left out.
    """
    spark = next(iter(tables.values())).sparkSession
    layout = "level int, table_name string, section int, batch_no bigint, line string"
    head = [f"-- {title or 'data'} ({dialect})", *HEADER[dialect]]
    fixed = [(-1, "", 0, i, line) for i, line in enumerate(head)]
    fixed += [(LAST_LEVEL, "~", 2, i, line) for i, line in enumerate(FOOTER[dialect])]
    parts = [spark.createDataFrame(fixed, layout)]
    for name, df in tables.items():
        level = F.lit(levels.get(name, 0)).alias("level")
        label = F.lit(name).alias("table_name")
        statements = insert_statements(df, name, dialect, orders[name], (declared or {}).get(name))
        parts.append(statements.select(level, label, F.lit(1).alias("section"), "batch_no", F.col("statement").alias("line")))
        counted = df.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
        note = F.concat(F.lit(f"-- {name}: "), F.col("_n").cast("string"), F.lit(" rows"))
        parts.append(counted.select(level, label, F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("batch_no"), note.alias("line")))
        counter = (auto_increment or {}).get(name)
        if dialect == "pg" and counter:
            top = df.agg(F.max(counter).alias("_m")).filter(F.col("_m").isNotNull())
            reset = F.concat(
                F.lit(f"SELECT setval(pg_get_serial_sequence('{name}', '{counter}'), "), F.col("_m").cast("string"), F.lit(", true);")
            )
            parts.append(
                top.select(
                    F.lit(LAST_LEVEL - 1).alias("level"), label, F.lit(1).alias("section"),
                    F.lit(0).cast("bigint").alias("batch_no"), reset.alias("line"),
                )
            )
    return reduce(DataFrame.unionByName, parts)
