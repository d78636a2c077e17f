"""Queries that write values, rows and scripts as SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.functions import literals as lit
from trilect.operators import export as x
from trilect.operators.score import score_report
from trilect.plans.derived import GRADED, QUERY_TEXTS
from trilect.plans.registry import Tables, per_dialect, plain, query
from trilect.session import ensure_checkpoint_dir
from trilect.sources import tables as io

_STAMP = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_NUMBER = "CASE WHEN o_totalprice = round(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.6f', o_totalprice), '0+$', '') END"


def _literals(dialect: str) -> str:
    truth = "CASE WHEN o_orderkey % 2 = 0 THEN {} ELSE {} END".format(*(["'TRUE'", "'FALSE'"] if dialect == "pg" else ["'1'", "'0'"]))
    oracle = dialect == "oracle"
    stamp = f"'TO_TIMESTAMP(''' || {_STAMP} || ''', ''YYYY-MM-DD HH24:MI:SS'')'" if oracle else f"'''' || {_STAMP} || ''''"
    date = f"'TO_DATE(''' || {_DAY} || ''', ''YYYY-MM-DD'')'" if oracle else f"'''' || {_DAY} || ''''"
    tags = "'ARRAY[''' || o_orderstatus || ''', ''x'']::TEXT[]'" if dialect == "pg" else "'''[' || {q} || o_orderstatus || {q} || ',' || {q} || 'x' || {q} || ']'''".format(
        q="'\\\"'" if dialect == "mysql" else "'\"'"
    )
    raw = {
        "mysql": "'0x' || hex(o_orderstatus)",
        "pg": "'E''\\\\x' || hex(o_orderstatus) || ''''",
        "oracle": "'HEXTORAW(''' || hex(o_orderstatus) || ''')'",
    }[dialect]
    return f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NULL' ELSE CAST(o_custkey AS VARCHAR) END AS whole, {_NUMBER} AS number,
        {truth} AS truth, {stamp} AS stamp, {date} AS day, '''' || o_orderpriority || '''' AS text, {tags} AS tags, {raw} AS raw FROM orders"""


@per_dialect("EX1_sql_literal", {k: _literals(k) for k in ("mysql", "pg", "oracle")})
def literals(t: Tables, dialect: str) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("whole"),
        F.col("o_totalprice").alias("number"),
        (F.col("o_orderkey") % 2 == 0).alias("truth"),
        F.col("o_orderdate").alias("stamp"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("text"),
        F.array("o_orderstatus", F.lit("x")).alias("tags"),
        F.encode("o_orderstatus", "UTF-8").alias("raw"),
    )
    types = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "o_orderkey", *[lit.sql_literal(c, types[c], dialect).alias(c) for c in rows.columns if c != "o_orderkey"]
    )


_TYPED = """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2024-01-15T08:30:00.250Z' WHEN 1 THEN '2024-01-15 08:30:00+08:00' WHEN 2 THEN '2024-01-15' WHEN 3 THEN '08:30:00.5'
      WHEN 4 THEN 'soon' ELSE NULL END AS at, CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' ELSE '0' END AS flag,
      CASE event_id % 5 WHEN 0 THEN '007' WHEN 1 THEN '1.50' WHEN 2 THEN 'abc' WHEN 3 THEN '2.0' ELSE CAST(event_id AS STRING) END AS num FROM {events}
    """


def _typed(dialect: str) -> str:
    true, false = ("TRUE", "FALSE") if dialect == "pg" else ("1", "0")
    mask = "YYYY-MM-DD HH24:MI:SS"
    if dialect == "oracle":
        moment = f"""CASE event_id % 6 WHEN 0 THEN 'TO_TIMESTAMP(''2024-01-15T08:30:00'', ''YYYY-MM-DD"T"HH24:MI:SS'')' WHEN 1 THEN 'TO_TIMESTAMP(''2024-01-15 08:30:00'', ''{mask}'')'
            WHEN 2 THEN 'TO_TIMESTAMP(''2024-01-15'', ''{mask}'')' WHEN 3 THEN 'TO_TIMESTAMP(''2024-01-01 08:30:00'', ''{mask}'')'
            WHEN 4 THEN 'TO_TIMESTAMP(''soon'', ''{mask}'')' ELSE 'NULL' END"""
    else:
        moment = """CASE event_id % 6 WHEN 0 THEN '''2024-01-15 08:30:00''' WHEN 1 THEN '''2024-01-15 08:30:00''' WHEN 2 THEN '''2024-01-15''' WHEN 3 THEN '''2024-01-01 08:30:00'''
            WHEN 4 THEN '''soon''' ELSE 'NULL' END"""
    return f"""SELECT event_id, {moment} AS moment, CASE event_id % 5 WHEN 0 THEN '{true}' WHEN 1 THEN '{false}' WHEN 2 THEN '{true}' WHEN 3 THEN '''maybe''' ELSE '{false}' END AS flag,
        CASE event_id % 5 WHEN 0 THEN '7' WHEN 1 THEN '1.5' WHEN 2 THEN '''abc''' WHEN 3 THEN '2' ELSE CAST(event_id AS VARCHAR) END AS num FROM events"""


@per_dialect("EX1_typed_text_literal", {k: _typed(k) for k in ("mysql", "pg", "oracle")})
def typed_literals(t: Tables, dialect: str) -> DataFrame:
    text = T.StringType()
    return t.sql(_TYPED.replace(" AS at,", " AS moment,")).select(
        "event_id",
        lit.sql_literal("moment", text, dialect, "TIMESTAMP").alias("moment"),
        lit.sql_literal("flag", text, dialect, "BOOLEAN").alias("flag"),
        lit.sql_literal("num", text, dialect, "DECIMAL(10,2)").alias("num"),
    )


def _escaped(dialect: str) -> str:
    if dialect != "mysql":
        return "SELECT conv_id, turn, replace(replace(text, '''', ''''''), chr(13), '') AS v FROM conversations"
    out = "text"
    for old, new in (("chr(92)", "chr(92) || chr(92)"), ("''''", "chr(92) || ''''"), ("'\"'", "chr(92) || '\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        out = f"replace({out}, {old}, {new})"
    return f"SELECT conv_id, turn, {out} AS v FROM conversations"


@per_dialect("EX2_escape", {k: _escaped(k) for k in ("mysql", "pg", "oracle")})
def escaped(t: Tables, dialect: str) -> DataFrame:
    return t.conversations.select("conv_id", "turn", lit.escape("text", dialect).alias("v"))


@query(
    "EX3_normalize_datetime_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS v FROM events""",
)
def datetime_text(t: Tables) -> DataFrame:
    zones = F.array(*[F.lit(z) for z in ("", "Z", "+08:00", "-0500")])
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.get(zones, (F.col("event_id") % 4).cast("int")), F.lit(" ")
    )
    return t.events.select("event_id", lit.normalize_datetime_text(text).alias("v"))


@query(
    "EX4_numeric_and_boolean_text",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '7' WHEN 1 THEN '1.5' WHEN 2 THEN NULL WHEN 3 THEN '2' ELSE CAST(event_id AS VARCHAR) END AS number,
              CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'TRUE' WHEN 3 THEN NULL ELSE 'FALSE' END AS truth FROM events""",
)
def number_text(t: Tables) -> DataFrame:
    return t.sql(_TYPED.replace(" AS at,", " AS moment,")).select(
        "event_id",
        lit.normalize_numeric_text("num").alias("number"),
        lit.normalize_boolean_text("flag", "pg").alias("truth"),
    )


_TUPLE = "'(' || o_orderkey || ', ''' || o_orderstatus || ''', ' || o_custkey || ')'"


def _inserts(dialect: str) -> str:
    q = "`" if dialect == "mysql" else '"'
    head = f"INSERT INTO {q}orders{q} ({q}o_orderkey{q}, {q}o_orderstatus{q}, {q}o_custkey{q}) VALUES"
    rows = f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, {_TUPLE} AS r FROM orders"
    if dialect == "oracle":
        return f"SELECT n AS batch_no, '{head} ' || r || ';' AS statement FROM ({rows})"
    return f"""SELECT CAST(floor(n / 50) AS BIGINT) AS batch_no, '{head}' || chr(10) || string_agg('  ' || r, ',' || chr(10) ORDER BY n) || ';' AS statement
        FROM ({rows}) GROUP BY 1"""


@per_dialect("EX5_insert_statements", {k: _inserts(k) for k in ("mysql", "pg", "oracle")})
def inserts(t: Tables, dialect: str) -> DataFrame:
    return x.insert_statements(
        t.orders.select("o_orderkey", "o_orderstatus", "o_custkey"), "orders", dialect, ["o_orderkey"]
    )


def _script(dialect: str) -> str:
    q = "`" if dialect == "mysql" else '"'

    def block(table: str, level: int, columns: str, key: str, text: str) -> str:
        names = ", ".join(f"{q}{c}{q}" for c in columns.split())
        rows = f"SELECT row_number() OVER (ORDER BY {key}) - 1 AS n, {text} AS r FROM {table}"
        head = f"INSERT INTO {q}{table}{q} ({names}) VALUES"
        if dialect == "oracle":
            return f"""SELECT CAST({level} AS INTEGER) AS level, '{table}' AS table_name, CAST(1 AS INTEGER) AS section, n AS batch_no,
                '{head} ' || r || ';' AS line FROM ({rows})
                UNION ALL SELECT {level}, '{table}', 0, 0, '-- {table}: ' || count(*) || ' rows' FROM {table}"""
        return f"""SELECT CAST({level} AS INTEGER) AS level, '{table}' AS table_name, CAST(1 AS INTEGER) AS section, CAST(floor(n / 50) AS BIGINT) AS batch_no,
            '{head}' || chr(10) || string_agg('  ' || r, ',' || chr(10) ORDER BY n) || ';' AS line FROM ({rows}) GROUP BY 4
            UNION ALL SELECT {level}, '{table}', 0, 0, '-- {table}: ' || count(*) || ' rows' FROM {table}"""

    fixed = [(-1, "", 0, i, line) for i, line in enumerate([f"-- shop ({dialect})", *x.HEADER[dialect]])]
    fixed += [(x.LAST_LEVEL, "~", 2, i, line) for i, line in enumerate(x.FOOTER[dialect])]
    lines = " UNION ALL ".join("SELECT {}, '{}', {}, {}, '{}'".format(a, b, c, i, line.replace("'", "''")) for a, b, c, i, line in fixed)
    parts = [
        block("nation", 0, "n_nationkey n_name", "n_nationkey", "'(' || n_nationkey || ', ''' || n_name || ''')'"),
        block("customer", 1, "c_custkey c_name c_nationkey", "c_custkey", "'(' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ')'"),
        lines,
    ]
    if dialect == "pg":
        parts.append(
            f"""SELECT {x.LAST_LEVEL - 1}, 'customer', 1, 0, 'SELECT setval(pg_get_serial_sequence(''customer'', ''c_custkey''), ' || max(c_custkey) || ', true);' FROM customer"""
        )
    return " UNION ALL ".join(parts)


@per_dialect("EX6_database_script", {k: _script(k) for k in ("mysql", "pg", "oracle")})
def script(t: Tables, dialect: str) -> DataFrame:
    tables = {
        "nation": t.nation.select("n_nationkey", "n_name"),
        "customer": t.customer.select("c_custkey", "c_name", "c_nationkey"),
    }
    return x.database_script(
        tables,
        {"nation": 0, "customer": 1},
        {"nation": ["n_nationkey"], "customer": ["c_custkey"]},
        dialect,
        auto_increment={"customer": "c_custkey"},
        title="shop",
    )


# --- what is written is read back ------------------------------------------------------


def _folder(t: Tables, name: str) -> str:
    """A new folder beside the session's checkpoints."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    "IO4_report_files",
    f"""SELECT database, count(*) AS n, count(*) FILTER (WHERE results_match) AS matched, (SELECT count(*) FROM ({plain(GRADED)}) g) AS reported
        FROM ({plain(GRADED)}) g GROUP BY 1""",
)
def report_files(t: Tables) -> DataFrame:
    results, folder = t.sql(GRADED), _folder(t, "report")
    io.write_report(score_report(results), results, folder)
    written = t.spark.read.schema("database string, results_match boolean").json(f"{folder}/results")
    report = t.spark.read.schema("total_queries bigint").json(f"{folder}/report")
    total = report.first()["total_queries"]
    return written.groupBy("database").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("results_match").alias("matched"), F.lit(total).cast("bigint").alias("reported")
    )


_RECORDS = """
    SELECT CASE o_orderkey % 7
             WHEN 0 THEN concat('{{"query_id": ', o_orderkey, ', broken')
             WHEN 1 THEN concat('{{"difficulty": "easy", "sql": "SELECT ', o_orderkey, '"}}')
             WHEN 2 THEN concat('{{"query_id": ', o_orderkey, ', "sql": "SELECT ', o_orderkey, '"}}')
             ELSE concat('{{"query_id": "ex_', o_orderkey, '", "sql": "SELECT ', o_orderkey, '"}}') END AS value
    FROM {orders}"""


def _corpus(t: Tables) -> str:
    folder = _folder(t, "corpus")
    t.sql(_RECORDS).write.text(folder)
    return folder


@query(
    "IO1_read_query_corpus",
    """SELECT CASE WHEN o_orderkey % 7 = 2 THEN '' ELSE 'ex_' END || o_orderkey AS query_id, 'SELECT ' || o_orderkey AS sql
       FROM orders WHERE o_orderkey % 7 > 1""",
)
def query_corpus(t: Tables) -> DataFrame:
    return io.read_query_corpus(t.spark, _corpus(t), lines=True).select("query_id", "sql")


@query(
    "IO1_rejects",
    """SELECT CASE o_orderkey % 7 WHEN 0 THEN 'not json' ELSE 'no id' END AS reason,
              CASE o_orderkey % 7 WHEN 0 THEN '{"query_id": ' || o_orderkey || ', broken'
                   ELSE '{"difficulty":"easy","sql":"SELECT ' || o_orderkey || '"}' END AS record
       FROM orders WHERE o_orderkey % 7 < 2""",
)
def query_corpus_rejects(t: Tables) -> DataFrame:
    return io.query_corpus_rejects(t.spark, _corpus(t), lines=True).select("reason", "record")


@query(
    "IO1_read_query_arrays",
    """SELECT CAST(o_orderkey AS VARCHAR) AS query_id, '{"}' || o_orderpriority || chr(10) || '[' AS sql FROM orders""",
)
def query_arrays(t: Tables) -> DataFrame:
    """Texts with quotes and brackets in them, a file of about two hundred records each."""
    folder = _folder(t, "arrays")
    record = F.struct(F.col("o_orderkey").alias("query_id"), F.concat(F.lit('{"}'), F.col("o_orderpriority"), F.lit("\n[")).alias("sql"))
    files = t.orders.groupBy(F.floor(F.col("o_orderkey") / 200).alias("f")).agg(F.collect_list(record).alias("records"))
    files.select(F.to_json("records").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return io.read_query_corpus(t.spark, folder).select("query_id", "sql")


@query(
    "IO2_read_differences",
    "SELECT 'd' || p_partkey AS id, p_name AS feature, p_brand AS category, p_type AS requirement FROM part",
)
def differences(t: Tables) -> DataFrame:
    folder = _folder(t, "differences")
    entry = F.struct(
        F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("feature"),
        F.col("p_brand").alias("category"),
        F.struct(F.array("p_type").alias("query_requirements")).alias("test_requirements"),
    )
    # A file of about a hundred entries each.
    files = t.part.groupBy(F.floor(F.col("p_partkey") / 100).alias("f")).agg(F.collect_list(entry).alias("differences"))
    files.select(F.to_json(F.struct("differences")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    read = io.explode_requirements(io.read_differences(t.spark, folder))
    return read.select("id", "feature", "category", "requirement")


@query(
    "IO2_rejects",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'no id' ELSE 'not json' END AS reason,
              '{"feature":"' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '"}' ELSE '", oops}' END AS record
       FROM part WHERE p_partkey % 5 < 2""",
)
def difference_rejects(t: Tables) -> DataFrame:
    """Entries without an id and entries that are damaged, among others."""
    folder = _folder(t, "damaged")
    key = F.col("p_partkey").cast("string")
    head = F.when(F.col("p_partkey") % 5 < 2, F.concat(F.lit('{"feature":"'), key)).otherwise(F.concat(F.lit('{"id":"'), key))
    tail = F.when((F.col("p_partkey") % 2 != 0) & (F.col("p_partkey") % 5 < 2), '", oops}').otherwise('"}')
    files = t.part.groupBy(F.floor(F.col("p_partkey") / 100).alias("f")).agg(F.collect_list(F.concat(head, tail)).alias("entries"))
    text = F.concat(F.lit('{"differences": ['), F.array_join("entries", ", "), F.lit("]}"))
    files.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return io.difference_rejects(t.spark, folder).select("reason", "record")


_FILED = f"SELECT query_id, 'db' || CAST(query_id % 12 AS STRING) AS database, dialect, sql FROM ({QUERY_TEXTS}) q"


@query("IO5_partitioned_query_files", f"SELECT query_id, database, dialect, sql FROM ({plain(_FILED)}) q")
def partitioned_files(t: Tables) -> DataFrame:
    folder = _folder(t, "queries")
    io.write_partitioned_queries(t.sql(_FILED), folder)
    layout = "query_id bigint, sql string, database string, dialect string"
    return t.spark.read.schema(layout).json(folder)


@query(
    "IO6_sql_dump_lines",
    """SELECT CAST((SELECT count(*) FROM customer) AS BIGINT) AS value_lines, CAST(ceil((SELECT count(*) FROM customer) / 50) AS BIGINT) AS statements""",
)
def dump_lines(t: Tables) -> DataFrame:
    folder = _folder(t, "dump")
    rows = t.customer.select("c_custkey", "c_name")
    io.write_sql_dump(x.database_script({"customer": rows}, {}, {"customer": ["c_custkey"]}, "pg"), folder)
    lines = t.spark.read.text(folder)
    return lines.agg(
        F.count_if(F.col("value").startswith("  (")).alias("value_lines"),
        F.count_if(F.col("value").startswith("INSERT INTO")).alias("statements"),
    )


_CASES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE NULL END AS name, upper(c_mktsegment) AS other FROM {customer}"


@query(
    "EX7_case_insensitive_align",
    f"SELECT id AS Id, coalesce(name, other) AS Name, CAST(NULL AS VARCHAR) AS missing FROM ({plain(_CASES)}) x",
)
def align(t: Tables) -> DataFrame:
    return x.case_insensitive_align(t.sql(_CASES).toDF("ID", "Name", "NAME"), ["Id", "Name", "missing"])


def _whole_inserts(dialect: str) -> str:
    """All columns of orders: doubles with their shortest digits, times in the dialect's form."""
    q = "`" if dialect == "mysql" else '"'
    names = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
    head = f"INSERT INTO {q}orders{q} ({', '.join(q + c + q for c in names)}) VALUES"
    price = "CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.6f', o_totalprice), '0') END"
    moment = "'''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''''"
    if dialect == "oracle":
        moment = f"'TO_TIMESTAMP(' || {moment} || ', ''YYYY-MM-DD HH24:MI:SS'')'"
    values = f"o_orderkey || ', ' || o_custkey || ', ''' || o_orderstatus || ''', ' || {price} || ', ' || {moment} || ', ''' || o_orderpriority || ''''"
    rows = f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, '(' || {values} || ')' AS r FROM orders"
    if dialect == "oracle":
        return f"SELECT n AS batch_no, '{head} ' || r || ';' AS statement FROM ({rows})"
    return f"""SELECT CAST(floor(n / 50) AS BIGINT) AS batch_no, '{head}' || chr(10) || string_agg('  ' || r, ',' || chr(10) ORDER BY n) || ';' AS statement
        FROM ({rows}) GROUP BY 1"""


@per_dialect("EX5_all_columns", {k: _whole_inserts(k) for k in ("mysql", "pg", "oracle")})
def whole_inserts(t: Tables, dialect: str) -> DataFrame:
    return x.insert_statements(t.orders, "orders", dialect, ["o_orderkey"])
