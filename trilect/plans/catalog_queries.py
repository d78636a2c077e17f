"""Queries over schema catalogs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilect.operators import catalog as c
from trilect.plans.derived import CATALOG, CATALOG_FLAGS, FK_EDGES, FK_LEVELS_ORACLE, FK_TABLES
from trilect.plans.registry import Tables, plain, query


def _observed(table: str, columns: list[tuple[str, str]], pk: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT 'shop' AS db, '{table}' AS table_name, CAST({i + 1} AS INTEGER) AS ordinal, '{name}' AS column_name, '{kind}' AS data_type,
            count(*) > count({name}) AS nullable, {str(name == pk).lower()} AS is_pk,
            CAST({f"max(length({name}))" if kind == "string" else "NULL"} AS INTEGER) AS max_length, count(*) AS row_count FROM {table}"""
        for i, (name, kind) in enumerate(columns)
    )


_CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"),
]
_DOCUMENTS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


@query(
    "C1_catalog_from_frames",
    _observed("customer", _CUSTOMER, "c_custkey") + " UNION ALL " + _observed("documents", _DOCUMENTS, "doc_id"),
)
def from_frames(t: Tables) -> DataFrame:
    frames = {"customer": t.customer, "documents": t.documents}
    return c.catalog_from_frames(frames, "shop", {"customer": "c_custkey", "documents": "doc_id"})


# One DDL file per part, in the dialect its key says.
_DDL = """
    SELECT p_partkey, 'db' || CAST(p_partkey AS STRING) AS db, CASE p_partkey % 2 WHEN 0 THEN 'mysql' ELSE 'pg' END AS dialect,
      CASE p_partkey % 2 WHEN 0 THEN
        '/* file, one */ CREATE TABLE IF NOT EXISTS `part_' || CAST(p_partkey AS STRING) || '` (' || chr(10) ||
        '  `id` INT NOT NULL AUTO_INCREMENT, -- key, of course' || chr(10) ||
        '  `name` VARCHAR(' || CAST(p_size + 20 AS STRING) || ') NOT NULL COMMENT ' || chr(39) || 'a, (b' || chr(39) || ',' || chr(10) ||
        '  `kind` ENUM(' || chr(39) || lower(p_type) || chr(39) || ', ' || chr(39) || 'other' || chr(39) || ') NULL,' || chr(10) ||
        '  price DECIMAL(10,2) DEFAULT 0,' || chr(10) || '  PRIMARY KEY (`id`),' || chr(10) || '  UNIQUE KEY (`name`),' || chr(10) ||
        '  CONSTRAINT `fk` FOREIGN KEY (`price`) REFERENCES `prices` (`id`) ON DELETE CASCADE' || chr(10) || ') ENGINE=InnoDB;'
      ELSE
        'CREATE TYPE "kind_enum" AS ENUM (' || chr(39) || lower(p_type) || chr(39) || ');' || chr(10) ||
        'CREATE TABLE "part_' || CAST(p_partkey AS STRING) || '" ("id" INTEGER PRIMARY KEY, "name" VARCHAR(' || CAST(p_size + 20 AS STRING) ||
        ') UNIQUE, "kind" "kind_enum", tags TEXT[] NOT NULL, "state" VARCHAR(5) CHECK (1 = 1), seen TIMESTAMP WITH TIME ZONE,' ||
        ' CHECK ("state" IN (' || chr(39) || 'on' || chr(39) || ', ' || chr(39) || 'off' || chr(39) || ')));'
      END AS ddl FROM {part}
    """


def _ddl_column(parity: int, ordinal: int, name: str, kind: str, flags: str, length: str = "NULL", allowed: str = "NULL") -> str:
    nullable, pk, auto, unique = (str(f == "1").lower() for f in flags)
    dialect = "mysql" if parity == 0 else "pg"
    return f"""SELECT 'db' || p_partkey AS db, '{dialect}' AS dialect, 'part_' || p_partkey AS table_name, CAST({ordinal} AS INTEGER) AS ordinal,
        '{name}' AS column_name, {kind} AS data_type, {nullable} AS nullable, {pk} AS is_pk, {auto} AS is_auto, {unique} AS is_unique,
        CAST({length} AS INTEGER) AS max_length, CAST({allowed} AS VARCHAR) AS allowed_values FROM part WHERE p_partkey % 2 = {parity}"""


_VARCHAR = "'VARCHAR(' || (p_size + 20) || ')'"
_DDL_COLUMNS = " UNION ALL ".join(
    [
        _ddl_column(0, 1, "id", "'INT'", "0110"),
        _ddl_column(0, 2, "name", _VARCHAR, "0001", "p_size + 20"),
        _ddl_column(0, 3, "kind", "'ENUM(''' || lower(p_type) || ''', ''other'')'", "1000", allowed="lower(p_type) || '|other'"),
        _ddl_column(0, 4, "price", "'DECIMAL(10,2)'", "1000"),
        _ddl_column(1, 1, "id", "'INTEGER'", "0100"),
        _ddl_column(1, 2, "name", _VARCHAR, "1001", "p_size + 20"),
        _ddl_column(1, 3, "kind", "'kind_enum'", "1000", allowed="lower(p_type)"),
        _ddl_column(1, 4, "tags", "'TEXT[]'", "0000"),
        _ddl_column(1, 5, "state", "'VARCHAR(5)'", "1000", "5", "'on|off'"),
        _ddl_column(1, 6, "seen", "'TIMESTAMP WITH TIME ZONE'", "1000"),
    ]
)


@query("C2_catalog_from_ddl", _DDL_COLUMNS)
def from_ddl(t: Tables) -> DataFrame:
    columns = c.catalog_from_ddl(t.sql(_DDL))
    return columns.withColumn("allowed_values", F.array_join("allowed_values", "|"))


@query(
    "C2_foreign_keys_from_ddl",
    """SELECT 'db' || p_partkey AS db, 'mysql' AS dialect, 'part_' || p_partkey AS table_name, 'price' AS columns, 'prices' AS ref_table,
              'id' AS ref_columns FROM part WHERE p_partkey % 2 = 0""",
)
def fks_from_ddl(t: Tables) -> DataFrame:
    keys = c.foreign_keys_from_ddl(t.sql(_DDL)).select("db", "dialect", "table_name", "columns", "ref_table", "ref_columns")
    return keys.withColumn("columns", F.array_join("columns", ",")).withColumn("ref_columns", F.array_join("ref_columns", ","))


# Constraints in other places and spellings, parts that can't be read, and a statement without its end.
_KEYED = """
    SELECT p_partkey, 'db' || CAST(p_partkey AS STRING) AS db, 'pg' AS dialect,
      translate('CREATE TABLE sales.maker (id BIGINT CONSTRAINT pk_m PRIMARY KEY, code VARCHAR(4) DEFAULT ~UNIQUE~);' ||
      'CREATE TABLE sales."part" (id BIGINT DEFAULT nextval(~a, b~) NOT NULL, ' ||
      'maker BIGINT REFERENCES sales.maker ON DELETE SET NULL, brand TEXT DEFAULT ~' || lower(p_brand) || '~::text, ' ||
      'kind TEXT CHECK (kind IN (~it~~s~, ~(' || lower(p_type) || ')~)), ' ||
      'size INT DEFAULT -' || CAST(p_size AS STRING) || ' CHECK (size < 0), CONSTRAINT two UNIQUE (brand, kind), ' ||
      'CONSTRAINT out FOREIGN KEY (brand, "size") REFERENCES pub.brands (name, "of") ON UPDATE CASCADE ON DELETE NO ACTION, ' ||
      'EXCLUDE USING gist (brand WITH =)' || CASE p_partkey % 3 WHEN 0 THEN ', odd INT SPARSE' ELSE '' END || ');' ||
      CASE p_partkey % 2 WHEN 0 THEN 'CREATE TABLE last (id INT)' ELSE '' END, '~', chr(39)) AS ddl FROM {part}
    """


def _per_part(names: str, *rows: str) -> str:
    """SQL with the given rows for every part: each lists the values of the columns ``names`` and may end in a condition."""
    parts = [r.partition(" WHERE ") for r in rows]
    return " UNION ALL ".join(
        f"SELECT 'db' || p_partkey AS db, v.* FROM part, LATERAL (SELECT {values}) AS v({names}) WHERE {condition or 'true'}"
        for values, _, condition in parts
    )


@query(
    "C2_constraints_from_ddl",
    _per_part(
        "table_name, constraint_name, kind, columns, text",
        "'maker', 'pk_m', 'primary key', 'id', NULL",
        "'maker', NULL, 'default', 'code', '''UNIQUE'''",
        "'part', NULL, 'default', 'id', 'nextval(''a, b'')'",
        "'part', NULL, 'default', 'brand', '''' || lower(p_brand) || '''::text'",
        "'part', NULL, 'check', 'kind', 'kind IN (''it''''s'', ''(' || lower(p_type) || ')'')'",
        "'part', NULL, 'default', 'size', '-' || p_size",
        "'part', NULL, 'check', '', 'size < 0'",
        "'part', 'two', 'unique', 'brand,kind', NULL",
    ),
)
def constraints(t: Tables) -> DataFrame:
    found = c.constraints_from_ddl(t.sql(_KEYED)).withColumn("columns", F.array_join("columns", ","))
    return found.select("db", "table_name", "constraint_name", "kind", "columns", "text")


@query(
    "C2_foreign_keys_qualified",
    _per_part(
        "schema_name, table_name, constraint_name, columns, ref_schema, ref_table, ref_columns, on_delete, on_update",
        "'sales', 'part', NULL, 'maker', 'sales', 'maker', 'id', 'SET NULL', NULL",
        "'sales', 'part', 'out', 'brand,size', 'pub', 'brands', 'name,of', 'NO ACTION', 'CASCADE'",
    ),
)
def qualified_keys(t: Tables) -> DataFrame:
    keys = c.foreign_keys_from_ddl(t.sql(_KEYED)).drop("dialect")
    return keys.withColumn("columns", F.array_join("columns", ",")).withColumn("ref_columns", F.array_join("ref_columns", ","))


@query(
    "C2_columns_with_lists",
    _per_part(
        "table_name, ordinal, column_name, data_type, nullable, is_pk, is_unique, allowed_values",
        "'maker', 1, 'id', 'BIGINT', false, true, false, NULL",
        "'maker', 2, 'code', 'VARCHAR(4)', true, false, false, NULL",
        "'part', 1, 'id', 'BIGINT', false, false, false, NULL",
        "'part', 2, 'maker', 'BIGINT', true, false, false, NULL",
        "'part', 3, 'brand', 'TEXT', true, false, false, NULL",
        "'part', 4, 'kind', 'TEXT', true, false, false, 'it''s|(' || lower(p_type) || ')'",
        "'part', 5, 'size', 'INT', true, false, false, NULL",
        "'part', 6, 'odd', 'INT', true, false, false, NULL WHERE p_partkey % 3 = 0",
    ),
)
def columns_with_lists(t: Tables) -> DataFrame:
    found = c.catalog_from_ddl(t.sql(_KEYED)).withColumn("allowed_values", F.array_join("allowed_values", "|"))
    return found.select("db", "table_name", "ordinal", "column_name", "data_type", "nullable", "is_pk", "is_unique", "allowed_values")


@query(
    "C2_ddl_rejects",
    _per_part(
        "statement, part",
        "'CREATE TABLE part', 'EXCLUDE USING gist (brand WITH =)'",
        "'CREATE TABLE part', 'odd INT SPARSE' WHERE p_partkey % 3 = 0",
        "'CREATE TABLE last (id INT)', NULL WHERE p_partkey % 2 = 0",
    ),
)
def unread(t: Tables) -> DataFrame:
    return c.ddl_rejects(t.sql(_KEYED)).select("db", "statement", "part")


@query(
    "C3_classify_type",
    f"""WITH c AS ({plain(CATALOG)}), f AS ({CATALOG_FLAGS})
        SELECT db, table_name, ordinal, data_type, array_to_string(list_filter(classes, lambda x: x <> 'nullable'), ',') AS classes FROM f""",
)
def classify(t: Tables) -> DataFrame:
    return t.sql(CATALOG).select("db", "table_name", "ordinal", "data_type", c.classify_type("data_type").alias("classes"))


# The other side of a comparison: some columns dropped, renamed or moved.
_OTHER = f"""
    SELECT db, upper(table_name) AS table_name, CASE WHEN ordinal = 20 THEN 19 WHEN ordinal = 19 THEN 20 ELSE ordinal END AS ordinal,
           CASE WHEN ordinal = 7 THEN column_name || '_x' ELSE upper(column_name) END AS column_name
    FROM ({CATALOG}) k WHERE ordinal <> 5
    """


@query(
    "C4_catalog_diff",
    f"""WITH a AS (SELECT db, lower(table_name) AS table_name, lower(column_name) AS column_name, ordinal FROM ({plain(CATALOG)}) k),
        b AS (SELECT db, lower(table_name) AS table_name, lower(column_name) AS column_name, ordinal FROM ({plain(_OTHER)}) k)
        SELECT db, table_name, column_name, a.ordinal AS left_ordinal, b.ordinal AS right_ordinal,
               CASE WHEN b.ordinal IS NULL THEN 'left_only' WHEN a.ordinal IS NULL THEN 'right_only' ELSE 'moved' END AS status
        FROM a FULL JOIN b USING (db, table_name, column_name) WHERE a.ordinal IS DISTINCT FROM b.ordinal""",
)
def diff(t: Tables) -> DataFrame:
    return c.catalog_diff(t.sql(CATALOG), t.sql(_OTHER))


@query(
    "C5_types_equivalent",
    """SELECT p_partkey, a, b, CASE p_size % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN p_partkey % 2 = 0 WHEN 3 THEN true WHEN 4 THEN false
         WHEN 5 THEN true WHEN 6 THEN true ELSE false END AS same
       FROM (SELECT p_partkey, p_size, CASE p_size % 8 WHEN 0 THEN 'TINYINT(1)' WHEN 1 THEN 'JSON' WHEN 2 THEN 'VARCHAR(' || p_size || ')'
               WHEN 3 THEN 'BIGINT' WHEN 4 THEN 'TEXT' WHEN 5 THEN 'DOUBLE' WHEN 6 THEN 'DATETIME' ELSE 'DATE' END AS a,
             CASE p_size % 8 WHEN 0 THEN 'NUMBER(1)' WHEN 1 THEN 'CLOB' WHEN 2 THEN 'VARCHAR2(' || (p_size + p_partkey % 2) || ')'
               WHEN 3 THEN 'NUMBER(19)' WHEN 4 THEN 'NUMBER(10)' WHEN 5 THEN 'NUMBER(12,4)' WHEN 6 THEN 'TIMESTAMP' ELSE 'BLOB' END AS b FROM part)""",
)
def equivalent(t: Tables) -> DataFrame:
    k = F.col("p_size") % 8
    size = F.col("p_size").cast("string")
    wider = (F.col("p_size") + F.col("p_partkey") % 2).cast("string")
    mysql = ["TINYINT(1)", "JSON", None, "BIGINT", "TEXT", "DOUBLE", "DATETIME", "DATE"]
    oracle = ["NUMBER(1)", "CLOB", None, "NUMBER(19)", "NUMBER(10)", "NUMBER(12,4)", "TIMESTAMP", "BLOB"]

    def pick(types: list, sized):
        return F.coalesce(F.get(F.array(*[F.lit(x) for x in types]), k), sized)

    rows = t.part.select(
        "p_partkey",
        pick(mysql, F.concat(F.lit("VARCHAR("), size, F.lit(")"))).alias("a"),
        pick(oracle, F.concat(F.lit("VARCHAR2("), wider, F.lit(")"))).alias("b"),
    )
    same = c.types_equivalent(F.col("a"), F.lit("mysql"), F.col("b"), F.lit("oracle"))
    return rows.withColumn("same", same)


_ALLOWED = """
    SELECT 'db' AS db, 'mysql' AS dialect, 'T' || CAST(p_partkey AS STRING) AS table_name, 'State' AS column_name,
           CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'b,a,c' END AS allowed FROM {part}
    UNION ALL SELECT 'db', 'pg', 't' || CAST(p_partkey AS STRING), 'state', CASE WHEN p_partkey % 3 = 0 THEN 'x,y' WHEN p_partkey % 3 = 1 THEN 'c,a' ELSE '' END FROM {part}
    UNION ALL SELECT 'db', 'oracle', 't' || CAST(p_partkey AS STRING), 'STATE', CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE '' END FROM {part}
    """


@query(
    "C6_sync_allowed_values",
    f"""WITH x AS ({plain(_ALLOWED)}), k AS (
          SELECT CAST(substr(table_name, 2) AS BIGINT) AS p, max(allowed) FILTER (WHERE dialect = 'mysql') AS m, max(allowed) FILTER (WHERE dialect = 'pg') AS g,
                 max(allowed) FILTER (WHERE dialect = 'oracle') AS o FROM x GROUP BY 1),
        s AS (SELECT p, o, CASE WHEN m = '' THEN g WHEN g = 'c,a' THEN 'a,c' ELSE m END AS mg FROM k),
        a AS (SELECT p, CASE WHEN o = '' THEN mg WHEN mg = '' THEN o WHEN mg LIKE '%a%' THEN 'a' ELSE mg END AS agreed FROM s)
        SELECT dialect, table_name, CASE WHEN allowed <> '' THEN allowed ELSE agreed END AS allowed
        FROM x JOIN a ON p = CAST(substr(table_name, 2) AS BIGINT)""",
)
def sync_allowed(t: Tables) -> DataFrame:
    sets = F.when(F.col("allowed") != "", F.split("allowed", ",")).otherwise(F.array().cast("array<string>"))
    synced = c.sync_allowed_values(t.sql(_ALLOWED).withColumn("allowed_values", sets))
    return synced.select(
        "dialect", "table_name", F.coalesce(F.array_join("allowed_values", ","), F.lit("")).alias("allowed")
    )


_LEVELS = FK_LEVELS_ORACLE.format(nodes=plain(FK_TABLES), edges=plain(FK_EDGES))


@query(
    "C7_fk_levels",
    _LEVELS
    + """SELECT db, table_name, CAST(level AS INTEGER) AS level, false AS cyclic FROM good
         UNION ALL SELECT n.db, n.table_name, CAST(last.level AS INTEGER), true FROM n ANTI JOIN good ON good.db = n.db AND good.table_name = n.table_name
         JOIN last ON last.db = n.db""",
)
def levels(t: Tables) -> DataFrame:
    return c.fk_levels(t.sql(FK_TABLES), t.sql(FK_EDGES))


@query(
    "C8_cyclic_tables",
    _LEVELS + "SELECT n.db, n.table_name FROM n ANTI JOIN good ON good.db = n.db AND good.table_name = n.table_name",
)
def cyclic(t: Tables) -> DataFrame:
    return c.cyclic_tables(t.sql(FK_TABLES), t.sql(FK_EDGES))


_FK_COLUMNS = f"SELECT db, table_name, upper(column_name) AS column_name, CASE WHEN ordinal = 3 THEN upper(table_name) ELSE 't0' END AS ref_table FROM ({CATALOG}) k WHERE is_fk"


@query(
    "C9_self_references_nullable",
    f"""SELECT db, table_name, ordinal, column_name, nullable OR ordinal = 3 OR (table_name = 't0' AND is_fk) AS nullable FROM ({plain(CATALOG)}) k""",
)
def self_references(t: Tables) -> DataFrame:
    forced = c.force_self_refs_nullable(t.sql(CATALOG), t.sql(_FK_COLUMNS))
    return forced.select("db", "table_name", "ordinal", "column_name", "nullable")


_NAMES = """
    SELECT 'db' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) AS db, p_partkey,
           replace(p_name, ' ', '_') || '_' || substr(md5(CAST(p_partkey AS STRING)), 1, 6) AS name FROM {part}
    """
_SHORT_NAMES = f"""
    SELECT db, CASE WHEN p_partkey % 6 = 0 THEN substr(name, 1, 7) WHEN p_partkey % 6 = 1 THEN substr(name, 1, 3) || 'q' || substr(name, 5)
      WHEN p_partkey % 6 = 2 THEN substr(name, 1, 2) || substr(name, 5) WHEN p_partkey % 6 = 3 THEN name || 'zz' WHEN p_partkey % 6 = 4 THEN 'other' || CAST(p_partkey AS STRING)
      ELSE upper(name) END AS name FROM ({_NAMES}) k
    """


@query(
    "C10_reconcile_names",
    f"""WITH r AS (SELECT DISTINCT db, lower(name) AS name FROM ({plain(_NAMES)}) k), l AS (SELECT DISTINCT db, lower(name) AS name FROM ({plain(_SHORT_NAMES)}) k),
        lone_l AS (SELECT * FROM l ANTI JOIN r USING (db, name)), lone_r AS (SELECT * FROM r ANTI JOIN l USING (db, name)),
        p AS (SELECT l.db, l.name, r.name AS match, CASE WHEN starts_with(r.name, l.name) THEN length(l.name)
                     WHEN levenshtein(l.name, r.name) <= 2 THEN length(l.name) * 10 END AS score
              FROM lone_l l JOIN lone_r r ON l.db = r.db)
        SELECT db, name, match, CAST(score AS INTEGER) AS score FROM p WHERE score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY db, name ORDER BY score DESC, match) = 1""",
)
def reconcile(t: Tables) -> DataFrame:
    return c.reconcile_names(t.sql(_SHORT_NAMES), t.sql(_NAMES).select("db", "name"))


_LONG_NAMES = """
    SELECT 'db' || CAST(o_custkey % 10 AS STRING) AS db, 'a_rather_long_identifier_prefix_of_' || CAST(o_orderkey AS STRING) AS name FROM {orders}
    UNION ALL SELECT 'db' || CAST(o_custkey % 10 AS STRING), 'short_' || CAST(o_orderkey AS STRING) FROM {orders}
    """


_CUT_NAMES = f"""SELECT db, name, left(name, 26) || left(md5(name), 4) AS cut
                FROM (SELECT DISTINCT * FROM ({plain(_LONG_NAMES)}) x) WHERE length(name) > 30"""


@query(
    "C11_shorten_identifiers",
    f"""WITH k AS ({_CUT_NAMES})
        SELECT db, name, cut AS short_name FROM k
        QUALIFY count(*) OVER (PARTITION BY db, upper(cut)) = 1""",
)
def shorten(t: Tables) -> DataFrame:
    """The names whose first form no other name has."""
    short = c.shorten_identifiers(t.sql(_LONG_NAMES), ["db"], "name")
    form = F.concat(F.left("name", F.lit(26)), F.left(F.md5("name"), F.lit(4)))
    return short.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("db", F.upper(form)))).filter("n = 1").drop("n")


@query(
    "C11_short_identifiers_unique",
    f"""WITH k AS ({_CUT_NAMES})
        SELECT db, count(*) AS names, count(*) AS distinct_short, CAST(30 AS INTEGER) AS longest,
               count(DISTINCT upper(cut)) AS kept_form, CAST(0 AS BIGINT) AS other_prefix FROM k GROUP BY db""",
)
def shorten_unique(t: Tables) -> DataFrame:
    """Every name has a short form of its own, no longer than allowed, that begins like the name."""
    form = F.concat(F.left("name", F.lit(26)), F.left(F.md5("name"), F.lit(4)))
    short = c.shorten_identifiers(t.sql(_LONG_NAMES), ["db"], "name")
    return short.groupBy("db").agg(
        F.count(F.lit(1)).alias("names"),
        F.count_distinct(F.upper("short_name")).alias("distinct_short"),
        F.max(F.length("short_name")).alias("longest"),
        F.count_if(F.col("short_name") == form).alias("kept_form"),
        F.count_if(F.left("name", F.lit(20)) != F.left("short_name", F.lit(20))).alias("other_prefix"),
    )


@query(
    "C12_normalize_identifier",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN lower(replace(p_name, ' ', '_')) ELSE lower(replace(p_name, ' ', '_')) || '_x' END AS v FROM part""",
)
def normalize(t: Tables) -> DataFrame:
    name = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    kind = F.col("p_partkey") % 3
    quoted = (
        F.when(kind == 0, F.concat(F.lit(' "shop"."'), name, F.lit('_X" ')))
        .when(kind == 1, F.concat(F.lit("`"), name, F.lit("_X`")))
        .otherwise(F.concat(F.lit("shop."), name))
    )
    return t.part.select("p_partkey", c.normalize_identifier(quoted).alias("v"))
