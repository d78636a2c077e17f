"""Jobs over schema catalogs: many databases at once, constraints held as data.

Catalog columns: (db, dialect, table_name, ordinal, column_name, data_type,
nullable, is_pk, is_auto, is_unique, max_length, allowed_values). Foreign keys:
(db, dialect, table_name, columns, ref_table, ref_columns).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trilect.functions.columns import as_column
from trilect.functions.ddl import read_ddl
from trilect.operators.ordering import checked_broadcast, lookup_join, null_safe_join, offsets_of, positions, range_sorted
from trilect.operators.profile import KEY_NAMES
from trilect.operators.relational import full_key_diff, ordered_list
from trilect.session import cut, spread, store

# --- type classes -------------------------------------------------------------

# The declared types of each class.
STRING_TYPES = [
    "VARCHAR", "VARCHAR2", "CHAR", "TEXT", "LONGTEXT", "MEDIUMTEXT",
    "TINYTEXT", "CLOB", "NVARCHAR", "NCHAR", "NCLOB",
]
INTEGER_TYPES = ["INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "MEDIUMINT"]
DECIMAL_TYPES = ["DECIMAL", "NUMERIC", "FLOAT", "DOUBLE", "REAL", "BINARY_FLOAT", "BINARY_DOUBLE"]
DATE_TYPES = ["DATE", "DATETIME", "TIMESTAMP", "TIME", "YEAR", "TIMESTAMPTZ"]
BOOLEAN_TYPES = ["BOOLEAN", "BOOL", "TINYINT"]
JSON_TYPES = ["JSON", "JSONB"]
BINARY_TYPES = ["BLOB", "BYTEA", "LONGBLOB", "MEDIUMBLOB", "TINYBLOB", "VARBINARY", "BINARY"]


def base_type(data_type: str | Column) -> Column:
    """The type word before ``(`` or a blank, in upper case."""
    return F.regexp_extract(F.upper(as_column(data_type)), r"^([^(\s]*)", 1)


def _number_scale(data_type: str | Column) -> Column:
    """Scale of NUMBER(p,s), 0 for NUMBER(p) and for bare NUMBER."""
    scale = F.regexp_extract(F.upper(as_column(data_type)), r"NUMBER\(\d+,\s*(\d+)\)", 1)
    return F.coalesce(F.nullif(scale, F.lit("")).cast("int"), F.lit(0))


def is_string(t: str | Column) -> Column:
    return base_type(t).isin(STRING_TYPES)


def is_integer(t: str | Column) -> Column:
    return base_type(t).isin(INTEGER_TYPES) | ((base_type(t) == "NUMBER") & (_number_scale(t) == 0))


def is_decimal(t: str | Column) -> Column:
    return base_type(t).isin(DECIMAL_TYPES) | ((base_type(t) == "NUMBER") & (_number_scale(t) > 0))


def is_numeric(t: str | Column) -> Column:
    return base_type(t).isin([*INTEGER_TYPES, *DECIMAL_TYPES, "NUMBER"])


def is_date(t: str | Column) -> Column:
    return base_type(t).isin(DATE_TYPES)


def is_boolean(t: str | Column) -> Column:
    return base_type(t).isin(BOOLEAN_TYPES) | F.upper(as_column(t)).contains("NUMBER(1)")


def is_json(t: str | Column) -> Column:
    return base_type(t).isin(JSON_TYPES)


def is_binary(t: str | Column) -> Column:
    return base_type(t).isin(BINARY_TYPES)


def is_array(t: str | Column) -> Column:
    return as_column(t).contains("[]")


def classify_type(t: str | Column) -> Column:
    """All classes of a declared type, comma-joined; TINYINT is both integer and boolean."""
    tests = [
        ("string", is_string(t)),
        ("integer", is_integer(t)),
        ("decimal", is_decimal(t)),
        ("date", is_date(t)),
        ("boolean", is_boolean(t)),
        ("json", is_json(t)),
        ("enum", base_type(t) == "ENUM"),
        ("binary", is_binary(t)),
        ("array", is_array(t)),
    ]
    return F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in tests])


# --- catalog construction ---------------------------------------------------------


def catalog_from_frames(frames: dict[str, DataFrame], db: str, primary_keys: dict[str, str]) -> DataFrame:
    """Catalog rows of loaded tables: declared type plus what the data shows.

    One aggregation per table gives the row count, the NULLs and the longest text
    of every column, so ``nullable`` and ``max_length`` state facts.
    """
    out: list[DataFrame] = []
    for table, df in frames.items():
        fields = df.schema.fields
        seen = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(f.name).alias(f"n_{i}") for i, f in enumerate(fields)],
            *[
                (F.max(F.char_length(f.name)) if f.dataType.typeName() == "string" else F.lit(None).cast("int")).alias(
                    f"l_{i}"
                )
                for i, f in enumerate(fields)
            ],
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(db).alias("db"),
                    F.lit(table).alias("table_name"),
                    F.lit(i + 1).alias("ordinal"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    (F.col("rows") > F.col(f"n_{i}")).alias("nullable"),
                    F.lit(primary_keys.get(table) == f.name).alias("is_pk"),
                    F.col(f"l_{i}").alias("max_length"),
                    F.col("rows").alias("row_count"),
                )
                for i, f in enumerate(fields)
            ]
        )
        out.append(seen.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, out)


_TABLE = "schema_name string, table_name string"
_READ = {
    "columns": f"""{_TABLE}, ordinal int, column_name string, data_type string, nullable boolean, is_pk boolean, is_auto boolean,
        is_unique boolean, max_length int, allowed_values array<string>, default_value string""",
    "constraints": f"{_TABLE}, constraint_name string, kind string, columns array<string>, text string",
    "keys": f"""{_TABLE}, constraint_name string, columns array<string>, ref_schema string, ref_table string,
        ref_columns array<string>, on_delete string, on_update string""",
    "rejects": "statement string, part string, reason string",
}
# Files that are read before their rows are handed on.
_FILES = 1000


def _read_ddl(ddl: DataFrame, field: str) -> DataFrame:
    """db, dialect and the fields of ``field``, one row per item that ``read_ddl`` finds in the files (db, dialect, ddl).

    Brackets nest to any depth, which no regular expression follows, so each file's text
    is read by a small function; files are independent, and spread over all cores. Every
    text is read once: the rows come flat, so that no filter of lists reads it again.
    """
    found = T.DataType.fromDDL(_READ[field])
    names = found.fieldNames()

    def items(text: str | None, dialect: str | None) -> list[tuple]:
        read = read_ddl(text or "", dialect or "")
        if field == "rejects":
            return [tuple(r[n] for n in names) for r in read["rejects"]]
        return [(x["schema_name"], x["table_name"], *[i[n] for n in names[2:]]) for x in read["tables"] for i in x[field]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _FILES):
                files = whole.slice(begin, _FILES)
                read = [items(t, d) for t, d in zip(files["ddl"].to_pylist(), files["dialect"].to_pylist())]
                of = pa.array([k for k, some in enumerate(read) for _ in some], pa.int64())
                columns = list(zip(*[i for some in read for i in some])) or [()] * len(names)
                cells = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([files["db"].take(of), files["dialect"].take(of), *cells], ["db", "dialect", *names])

    kinds = [f.type for f in to_arrow_schema(found)]
    texts = spread(ddl.select("db", "dialect", "ddl"))
    return texts.mapInArrow(rows, T.StructType([texts.schema["db"], texts.schema["dialect"], *found.fields]))


def ddl_rejects(ddl: DataFrame) -> DataFrame:
    """(db, dialect, statement, part, reason): what of CREATE TABLE and TYPE statements could not be read.

    ``part`` is NULL where the whole statement gives no rows, as one without its end.
    """
    return _read_ddl(ddl, "rejects")


def catalog_from_ddl(ddl: DataFrame) -> DataFrame:
    """Catalog columns from DDL files: (db, dialect, ddl), one row per file.

    All constraints of a table are read from its own row, so nothing is shuffled.
    """
    return _read_ddl(ddl, "columns").drop("schema_name", "default_value")


def constraints_from_ddl(ddl: DataFrame) -> DataFrame:
    """(db, dialect, schema_name, table_name, constraint_name, kind, columns, text), inline constraints included.

    ``kind`` is primary key, unique, check or default; ``text`` has a check's condition or a default's value.
    """
    return _read_ddl(ddl, "constraints")


def foreign_keys_from_ddl(ddl: DataFrame) -> DataFrame:
    """(db, dialect, table_name, columns, ref_table, ref_columns), then schema_name, constraint_name, ref_schema, on_delete, on_update.

    A key that names no columns means the primary key, as far as the other table is in the file.
    """
    keys = _read_ddl(ddl, "keys")
    first = ["db", "dialect", "table_name", "columns", "ref_table", "ref_columns"]
    return keys.select(*first, *[c for c in keys.columns if c not in first])


# --- summaries and choices over a catalog --------------------------------------------

TABLE = ["db", "table_name"]


def profiled_columns(catalog: DataFrame, fk_columns: DataFrame) -> DataFrame:
    """Numeric and date columns that are no key: the ones a MIN/MAX profile covers."""
    keyed = fk_columns.select("db", "table_name", F.lower("column_name").alias("_c")).distinct()
    wanted = catalog.filter(
        (is_numeric("data_type") | is_date("data_type")) & ~F.col("is_pk") & ~F.col("is_auto")
    ).withColumn("_c", F.lower("column_name"))
    return wanted.join(keyed, ["db", "table_name", "_c"], "left_anti").drop("_c")


def table_summary(catalog: DataFrame) -> DataFrame:
    """(db, table_name, type_class, n_columns, columns): column lists per type class.

    A table has at most a few thousand columns in any of the three engines, which
    bounds every list. ``nullable`` is listed as a class of its own.
    """
    classes = F.split(classify_type("data_type"), ",")
    with_flags = F.concat(
        classes, F.when(F.col("nullable") & ~F.col("is_pk"), F.array(F.lit("nullable"))).otherwise(F.array().cast("array<string>"))
    )
    return (
        catalog.select(*TABLE, "ordinal", "column_name", F.explode(with_flags).alias("type_class"))
        .filter(F.col("type_class") != "")
        .groupBy(*TABLE, "type_class")
        .agg(F.count(F.lit(1)).alias("n_columns"), ordered_list("column_name", "ordinal").alias("columns"))
    )


def pick_entity_tables(catalog: DataFrame) -> DataFrame:
    """Tables with a column that is no key and a text column that is no foreign key.

    ``catalog`` carries ``is_fk``.
    """
    plain = ~F.col("is_pk") & ~F.col("is_fk")
    text = is_string("data_type") & ~F.col("is_fk")
    return (
        catalog.groupBy(*TABLE)
        .agg(F.count_if(plain).alias("n_plain"), F.count_if(text).alias("n_text"))
        .filter((F.col("n_plain") > 0) & (F.col("n_text") > 0))
    )


# Names that identify an entity, and the words looked for when none is there.
ENTITY_NAMES = [
    "name", "shortname", "short_name", "title", "fullname", "full_name", "superhero_name", "label",
    "tag_name", "community_area_name", "district_name", "city_name",
]
ENTITY_WORDS = ["name", "title", "school", "label", "description"]


def pick_dedup_fields(catalog: DataFrame) -> DataFrame:
    """Per table the text columns entities are told apart by.

    Columns with an exact name, else those that contain a known word and are no
    primary key, else the first text column that is no primary key.
    """
    name = F.lower("column_name")
    word = reduce(lambda a, b: a | b, [name.contains(w) for w in ENTITY_WORDS])
    tier = (
        F.when(name.isin(ENTITY_NAMES), F.lit(1))
        .when(~F.col("is_pk") & word, F.lit(2))
        .when(~F.col("is_pk"), F.lit(3))
    )
    text = catalog.filter(is_string("data_type")).withColumn("tier", tier).filter(F.col("tier").isNotNull())
    per_table = Window.partitionBy(*TABLE)
    return (
        text.withColumn("_best", F.min("tier").over(per_table))
        .withColumn("_first", F.min("ordinal").over(per_table))
        .filter((F.col("tier") == F.col("_best")) & ((F.col("tier") < 3) | (F.col("ordinal") == F.col("_first"))))
        .select(*TABLE, "ordinal", "column_name", "tier")
    )


def is_bridge(catalog: DataFrame) -> DataFrame:
    """(db, table_name, is_bridge): two or more key columns, every one a foreign key."""
    return catalog.groupBy(*TABLE).agg(
        ((F.count_if(F.col("is_pk")) >= 2) & (F.count_if(F.col("is_pk") & ~F.col("is_fk")) == 0)).alias("is_bridge")
    )


def core_column(catalog: DataFrame) -> DataFrame:
    """Per table its first text column that is no key: the one a row cannot be without."""
    return (
        catalog.filter(~F.col("is_pk") & ~F.col("is_fk") & is_string("data_type"))
        .groupBy(*TABLE)
        .agg(F.min_by("column_name", "ordinal").alias("core_column"))
    )


def content_dedup_fields(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.lower("column_name").isin(KEY_NAMES) & is_string("data_type"))


# --- comparing catalogs ----------------------------------------------------------------


def catalog_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns on one side only or at another place: ``status`` left_only, right_only or moved."""
    keys = ["db", "table_name", "column_name"]

    def named(df: DataFrame, ordinal: str) -> DataFrame:
        return df.select(
            "db", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"),
            F.col("ordinal").alias(ordinal),
        )

    both = named(a, "left_ordinal").join(named(b, "right_ordinal"), keys, "full")
    status = (
        F.when(F.col("right_ordinal").isNull(), F.lit("left_only"))
        .when(F.col("left_ordinal").isNull(), F.lit("right_only"))
        .when(F.col("left_ordinal") != F.col("right_ordinal"), F.lit("moved"))
    )
    return both.withColumn("status", status).filter(F.col("status").isNotNull())


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables on one side only."""
    lower = F.lower("table_name").alias("table_name")
    return full_key_diff(a.select("db", lower), b.select("db", lower), TABLE)


# Per type family, what each dialect may declare (base types, upper case).
EQUIVALENT_TYPES = {
    "boolean": {"mysql": ["TINYINT"], "pg": ["BOOLEAN"], "oracle": ["NUMBER(1)"]},
    "json": {"mysql": ["JSON"], "pg": ["JSONB", "TEXT[]"], "oracle": ["CLOB"]},
    "enum": {"mysql": ["ENUM"], "pg": ["USER-DEFINED"], "oracle": ["VARCHAR2"]},
    "integer": {"mysql": ["INT", "BIGINT"], "pg": ["INTEGER", "BIGINT"], "oracle": ["NUMBER(10)", "NUMBER(19)"]},
    "double": {"mysql": ["DOUBLE"], "pg": ["DOUBLE"], "oracle": ["BINARY_DOUBLE", "NUMBER(P,S)"]},
    "timestamp": {"mysql": ["DATETIME"], "pg": ["TIMESTAMP"], "oracle": ["TIMESTAMP"]},
    "varchar": {"mysql": ["VARCHAR"], "pg": ["VARCHAR"], "oracle": ["VARCHAR2"]},
    "text": {"mysql": ["TEXT"], "pg": ["TEXT"], "oracle": ["CLOB"]},
}


def _rule_name(t: Column) -> Column:
    """How the rule table spells a declared type."""
    upper = F.upper(t)
    return (
        F.when(upper.rlike(r"^NUMBER\(\d+,\s*[1-9]\d*\)"), F.lit("NUMBER(P,S)"))
        .when(upper.rlike(r"^NUMBER\(\d+\)"), F.regexp_extract(upper, r"^(NUMBER\(\d+\))", 1))
        .when(upper.contains("[]"), upper)
        .otherwise(base_type(t))
    )


def type_families(data_type: str | Column, dialect: str | Column) -> Column:
    """The families a declared type belongs to; a VARCHAR family carries its length."""
    t, d = as_column(data_type), as_column(dialect)
    spelled = _rule_name(t)
    length = F.regexp_extract(t, r"\((\d+)", 1)
    found = []
    for family, by_dialect in EQUIVALENT_TYPES.items():
        test = reduce(lambda x, y: x | y, [(d == name) & spelled.isin(types) for name, types in by_dialect.items()])
        label = F.concat(F.lit("varchar:"), length) if family == "varchar" else F.lit(family)
        found.append(F.when(test, label))
    return F.array_compact(F.array(*found))


def types_equivalent(a: Column, a_dialect: Column, b: Column, b_dialect: Column) -> Column:
    """Same declaration, or a family in common."""
    return (F.upper(a) == F.upper(b)) | F.arrays_overlap(type_families(a, a_dialect), type_families(b, b_dialect))


def sync_allowed_values(catalog: DataFrame) -> DataFrame:
    """Fill missing ``allowed_values`` from the other dialects of the same column.

    The sets are intersected in dialect order, an empty intersection keeps the set
    so far; columns that have a set keep their own.
    """
    same = Window.partitionBy("db", F.lower("table_name"), F.lower("column_name"))

    def of(dialect: str) -> Column:
        own = F.when((F.col("dialect") == dialect) & (F.size("allowed_values") > 0), F.col("allowed_values"))
        return F.max(own).over(same)

    def narrow(so_far: Column, more: Column) -> Column:
        common = F.array_sort(F.array_intersect(so_far, more))
        return (
            F.when(so_far.isNull(), more)
            .when(more.isNull(), so_far)
            .when(F.size(common) > 0, common)
            .otherwise(so_far)
        )

    agreed = narrow(narrow(of("mysql"), of("pg")), of("oracle"))
    return catalog.withColumn(
        "allowed_values", F.when(F.size("allowed_values") > 0, F.col("allowed_values")).otherwise(agreed)
    )


# --- foreign-key order ---------------------------------------------------------------


def _levels(db: pd.DataFrame) -> pd.DataFrame:
    """The levels of one database's tables; rows without a ref_table name the tables."""
    tables = db.loc[db["ref_table"].isna(), "table_name"].unique()
    known = set(tables)
    above: dict[str, set[str]] = {t: set() for t in tables}
    below: dict[str, list[str]] = {t: [] for t in tables}
    for table, ref in zip(db["table_name"], db["ref_table"]):
        if table in known and ref in known and table.lower() != ref.lower() and ref not in above[table]:
            above[table].add(ref)
            below[ref].append(table)
    waiting = {t: len(refs) for t, refs in above.items()}
    level, ready = {}, [t for t in tables if not waiting[t]]
    depth = 0
    while ready:
        level |= dict.fromkeys(ready, depth)
        freed = []
        for t in ready:
            for child in below[t]:
                waiting[child] -= 1
                if not waiting[child]:
                    freed.append(child)
        ready, depth = freed, depth + 1
    out = pd.DataFrame({"db": [db["db"].iloc[0]] * len(tables), "table_name": tables})
    out["level"] = [level.get(t, depth) for t in tables]
    out["cyclic"] = [t not in level for t in tables]
    return out


def fk_levels(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(db, table_name, level, cyclic): parents before children, for all databases in one pass.

    ``edges`` holds (db, table_name, ref_table). A table is placed once all the
    tables it refers to are; self references and unknown tables do not count.
    Tables on or behind a cycle come last, one level after the rest of their database.

    A database has a few thousand tables at most, so each one's edges meet in one
    task, behind the only exchange.
    """
    nodes = tables.select(*TABLE, F.lit(None).cast("string").alias("ref_table"))
    both = nodes.unionByName(edges.select(*TABLE, "ref_table").filter("ref_table IS NOT NULL"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = f"db {kinds['db']}, table_name {kinds['table_name']}, level int, cyclic boolean"
    return both.groupBy("db").applyInPandas(_levels, schema)


def cyclic_tables(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables whose foreign keys have to be added after all tables exist."""
    return fk_levels(tables, edges).filter("cyclic").select(*TABLE)


def force_self_refs_nullable(catalog: DataFrame, fk_columns: DataFrame) -> DataFrame:
    """Columns of a self reference lose NOT NULL; all others stay as they are.

    ``fk_columns`` holds (db, table_name, column_name, ref_table).
    """
    own = (
        fk_columns.filter(F.lower("ref_table") == F.lower("table_name"))
        .select("db", "table_name", F.lower("column_name").alias("_c"))
        .distinct()
        .withColumn("_self", F.lit(True))
    )
    joined = catalog.withColumn("_c", F.lower("column_name")).join(own, ["db", "table_name", "_c"], "left")
    return joined.withColumn("nullable", F.col("nullable") | F.coalesce("_self", F.lit(False))).drop("_c", "_self")


# --- names ---------------------------------------------------------------------------

_ANY = "\u0001"  # stands for one replaced character
# Pairs of names that a database may form.
PAIRS = 1 << 22


def _one_edit(text: Column) -> Column:
    """All results of dropping or masking one character."""
    places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))
    return F.concat(
        F.transform(places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))),
        F.transform(places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.lit(_ANY), F.substr(text, i + 1))),
    )


def _edit_keys(df: DataFrame, name: str) -> DataFrame:
    """One row per way to drop or mask at most two characters, with the counts of both.

    A name becomes about a thousand rows, so the names are spread first; a given
    number of partitions is not merged again for being small before the explode.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = F.array_distinct(_one_edit(F.col(name)))
    keys = df.withColumn("_once", once).withColumn(
        "_keys",
        F.array_distinct(
            F.concat(F.array(F.col(name)), F.col("_once"), F.flatten(F.transform("_once", _one_edit)))
        ),
    )
    # the outer explode infers no filter, which would build the keys once more at the scan
    exploded = keys.select(*df.columns, F.explode_outer("_keys").alias("_key"))
    return exploded.withColumn("_drops", F.char_length(name) - F.char_length("_key")).withColumn(
        "_masks", F.char_length("_key") - F.char_length(F.replace(F.col("_key"), F.lit(_ANY), F.lit("")))
    )


def reconcile_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(db, name, match, score): the most likely right name of every unmatched left name.

    Inputs hold (db, name). A right name at edit distance 1 or 2 scores ten times the
    left name's length; one that starts with the left name scores that length, and
    counts only as a prefix match. Among equal scores the first name wins.

    The names of a database meet pair by pair where that takes fewer rows than their edit
    keys would, and ``PAIRS`` at most; those of larger databases meet by keys.
    """

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select("db", F.lower("name").alias("name"), F.lit(is_left).alias("_left"))

    ends = [F.min("_left").alias("_least"), F.max("_left").alias("_left")]
    named = side(left, True).unionByName(side(right, False)).groupBy("db", "name").agg(*ends)
    lone = store(named.filter(F.col("_least") == F.col("_left")).drop("_least"))
    # a name of n characters has about 2 * n * n keys
    keys = F.sum(F.char_length("name").cast("bigint") * F.char_length("name") * 2 + 1)
    pairs = F.count_if("_left") * F.count_if(~F.col("_left"))
    sizes = store(lone.groupBy("db").agg((pairs <= F.least(keys, F.lit(PAIRS))).alias("_few")))

    def sides(few: bool) -> tuple[DataFrame, DataFrame]:
        dbs = sizes.filter(F.col("_few") == F.lit(few)).select("db")
        own = lookup_join(lone, dbs, ["db"], "left_semi", counted=True)
        return own.filter("_left").drop("_left"), own.filter(~F.col("_left")).drop("_left")

    by_pairs = _reconcile_by_pairs(*sides(True))
    if sizes.filter(~F.col("_few")).isEmpty():
        return by_pairs
    return by_pairs.unionByName(_reconcile_by_keys(*sides(False)))


def _reconcile_by_pairs(lone_left: DataFrame, lone_right: DataFrame) -> DataFrame:
    prefix = F.col("match").startswith(F.col("name"))
    near = F.levenshtein("name", "match", 2) >= 0

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("match")))

    return (
        lone_left.join(lone_right.withColumnRenamed("name", "match"), "db")
        .filter((F.col("name") != "") & (prefix | near))
        .groupBy("db", "name")
        .agg(first(~prefix).alias("_edit"), first(prefix).alias("_prefix"))
        .select(
            "db",
            "name",
            F.coalesce("_edit", "_prefix").alias("match"),
            (F.char_length("name") * F.when(F.col("_edit").isNull(), 1).otherwise(10)).alias("score"),
        )
    )


def _reconcile_by_keys(lone_left: DataFrame, lone_right: DataFrame) -> DataFrame:
    """No pairs are formed: two names are within two edits exactly when dropping or
    masking characters, two in all, makes them the same text. The right side keeps
    one name per such text before the join.
    """
    prefixes = (
        lone_right.select(
            "db",
            F.col("name").alias("match"),
            F.explode_outer(
                F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.substr(F.col("name"), F.lit(1), i))
            ).alias("name"),
        )
        .groupBy("db", "name")
        .agg(F.min("match").alias("match"))
    )
    by_prefix = lone_left.join(prefixes, ["db", "name"]).select(
        "db", "name", "match", F.char_length("name").alias("score")
    )

    # Prefix pairs must not come back as edits. A right name one drop and one mask
    # away continues the left name when it also agrees with the masked character,
    # so that character is part of the right side's grouping.
    masked_at = F.instr("_key", _ANY)
    visible = F.substr(F.col("match"), F.lit(1), F.char_length("_key"))
    same_start = F.when(
        F.col("_masks") == 1,
        F.concat(
            F.substr(visible, F.lit(1), masked_at - 1), F.lit(_ANY), F.substr(visible, masked_at + 1)
        )
        == F.col("_key"),
    ).otherwise(visible == F.col("_key"))
    continued = F.when(
        (F.col("_drops") > 0) & same_start & (F.col("_masks") <= 1),
        F.when(F.col("_masks") == 1, F.substr(F.col("match"), masked_at, F.lit(1))).otherwise(F.lit("")),
    )
    # Both sides are laid out by (db, key) once, which serves the grouping and the join.
    # The planner takes the sides for as small as the names they come from and would
    # broadcast one, so a merge join is asked for.
    n = int(lone_left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right_keys = (
        _edit_keys(lone_right.withColumnRenamed("name", "match"), "match")
        .select("db", "_key", "match", F.col("_drops").alias("_right_drops"), continued.alias("_continued"))
        .repartition(n, "db", "_key")
        .groupBy("db", "_key", "_right_drops", "_continued")
        .agg(F.min("match").alias("match"))
    )
    left_keys = _edit_keys(lone_left, "name").withColumnRenamed("_drops", "_left_drops").repartition(n, "db", "_key")
    met = left_keys.join(right_keys.hint("merge"), ["db", "_key"]).filter(
        (F.col("_left_drops") + F.col("_right_drops") + F.col("_masks") <= 2)
    )
    own_char = F.when(F.col("_masks") == 1, F.substr(F.col("name"), F.instr("_key", _ANY), F.lit(1))).otherwise(F.lit(""))
    by_edit = (
        met.filter(~((F.col("_left_drops") == 0) & F.col("_continued").eqNullSafe(own_char)))
        .groupBy("db", "name")
        .agg(F.min("match").alias("match"))
        .withColumn("score", F.char_length("name") * 10)
    )
    # at most one row of each kind per name
    return (
        by_prefix.unionByName(by_edit)
        .groupBy("db", "name")
        .agg(F.max_by("match", "score").alias("match"), F.max("score").alias("score"))
    )


def _with_passed(rows: DataFrame, within: Sequence[str]) -> DataFrame:
    """The rows that are not ``_passed`` with ``_before``: how many passed ones of their group have a smaller ``_n``."""
    staged = range_sorted(rows, [*within, "_n", "_passed"])
    one = F.when(F.col("_passed"), 1).otherwise(0)
    offsets = offsets_of(staged, within, {"_before": one}).drop("_first")
    here = Window.partitionBy("_pid", *within).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumn("_here", F.coalesce(F.sum(one).over(here), F.lit(0)))
    joined = null_safe_join(local, checked_broadcast(offsets), ["_pid", *within]).filter(~F.col("_passed"))
    return joined.withColumn("_before", F.col("_before") + F.col("_here")).drop("_here", "_pid", "_mid", "_passed")


def shorten_identifiers(names: DataFrame, scope: Sequence[str], name: str, max_len: int = 30) -> DataFrame:
    """(scope, name, short_name): names over ``max_len`` cut and closed with 4 md5 digits, unique within a scope.

    Short forms differ in more than case. Of names with one form the first keeps it; the
    others are cut further and numbered, with two digits while these last, then with three,
    and so on. Numbers whose form some name has already are passed over.

    Forms are grouped once and clashing names picked out once. A width is one round over the
    clashing names: the n-th of a stem gets the n-th number that is free. Names and taken
    numbers meet in one sorted order, so that no list of numbers is read for every name.
    """
    form = F.concat(F.left(F.col(name), F.lit(max_len - 4)), F.left(F.md5(name), F.lit(4)))
    key, within = F.upper(form).alias("_key"), [*scope, "_key"]
    long = names.filter(F.char_length(name) > max_len).select(*scope, name, key)
    firsts = store(long.groupBy(*within).agg(F.min(name).alias(name), F.max(name).alias("_last")))
    clash = firsts.filter(F.col(name) != F.col("_last")).select(*within, F.col(name).alias("_first"))
    others = null_safe_join(long, checked_broadcast(clash), within).filter(F.col(name) != F.col("_first"))
    rest, width = cut(others.select(*scope, name, form.alias("_form")).distinct()), 2
    given = [firsts.select(*scope, name, form.alias("short_name"))]
    taken = [firsts.select(*within)]
    while not rest.isEmpty():
        if width > max_len:
            raise ValueError(f"{max_len} characters are too few for the clashing names")
        cut_to, least = max_len - width, 0 if width == 2 else 10 ** (width - 1) - 1
        grouped = rest.withColumn("_stem", F.left("_form", F.lit(cut_to))).withColumn("_key", F.upper("_stem"))
        ranked = positions(grouped, [name], within, "_n")
        # The numbers that are taken behind each stem: at most 10 ** width.
        digits = F.substring("_key", cut_to + 1, width)
        numbers = reduce(DataFrame.unionByName, taken).filter(digits.rlike(f"^[0-9]{{{width}}}$"))
        numbers = numbers.select(*scope, F.left("_key", F.lit(cut_to)).alias("_key"), digits.cast("bigint").alias("_number"))
        numbers = positions(numbers.filter(F.col("_number") > least).distinct(), ["_number"], within, "_i")
        # The n-th free number has n free ones up to it: taken ones with fewer free ones below are passed.
        # Names by n and taken numbers by these free ones lie in one order; running sums count the passed.
        passing = numbers.select(*within, (F.col("_number") - F.lit(least) - F.col("_i")).alias("_n"), F.lit(True).alias("_passed"))
        both = ranked.withColumn("_passed", F.lit(False)).unionByName(passing, allowMissingColumns=True)
        placed = _with_passed(both, within).withColumn("_at", F.col("_n") + F.col("_before") + F.lit(least))
        placed = cut(placed.withColumn("short_name", F.concat("_stem", F.lpad(F.col("_at").cast("string"), width, "0"))))
        fits = F.col("_at") < 10**width
        given.append(placed.filter(fits).select(*scope, name, "short_name"))
        taken.append(placed.filter(fits).select(*scope, F.upper("short_name").alias("_key")))
        rest, width = placed.filter(~fits).select(*scope, name, "_form"), width + 1
    return reduce(DataFrame.unionByName, given)


def normalize_identifier(name: str | Column) -> Column:
    """The last part of a qualified name, without quotes, in lower case."""
    last = F.element_at(F.split(F.trim(as_column(name)), r"\."), -1)
    return F.lower(F.regexp_replace(last, r'^[`"](.*)[`"]$', "$1"))
