"""Queries that compare result sets, score query pairs and keep the books."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.operators import compare as m
from trilect.operators import score as s
from trilect.operators.ordering import lookup_join
from trilect.plans.derived import GRADED
from trilect.plans import registry
from trilect.plans.registry import Tables, plain, query
from trilect.session import cut, ensure_checkpoint_dir, spread

# --- result sets: forty-two queries with a source and a changed target, eight without rows ---

_SOURCE = """
    SELECT o_custkey % 42 AS query_id, o_custkey % 7 AS kind, o_orderkey AS K, CAST(o_totalprice AS DOUBLE) AS Price,
           CAST(o_orderdate AS DATE) AS Day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority || ', a, ' || o_orderstatus END AS Note
    FROM {orders}
    """
_TARGET = f"""
    SELECT query_id, kind, K, CASE kind WHEN 1 THEN Price * 1.00000001 WHEN 2 THEN Price * 1.001 ELSE Price END AS Price, Day,
           CASE WHEN kind = 5 THEN 'a, ' || substr(Note, length(Note), 1) || ', ' || substr(Note, 1, length(Note) - 6)
                WHEN kind = 6 AND Note IS NULL THEN 'x' ELSE Note END AS Note
    FROM ({_SOURCE}) q WHERE kind <> 3 OR K % 10 <> 0
    """


def _result_sets(t: Tables) -> DataFrame:
    """Kind 0 is copied, 1 and 2 are scaled, 3 loses rows, 4 gets a renamed column, 5 reordered lists, 6 filled NULLs."""
    source, target = spread(t.sql(_SOURCE)), spread(t.sql(_TARGET))


    def rows(df: DataFrame, side: str, note: str = "Note") -> DataFrame:
        data = df.select("K", "Price", "Day", F.col("Note").alias(note), "query_id")
        result = data.drop("query_id")
        return data.select(
            "query_id", F.lit(side).alias("side"), m.column_names(result).alias("columns"), m.row_sort_key(result).alias("cells")
        )

    same_names, renamed = target.filter(F.col("kind") != 4), target.filter(F.col("kind") == 4)
    return (
        rows(source, "source")
        .unionByName(rows(same_names, "target"))
        .unionByName(rows(renamed, "target", "Remark"))
    )


def _all_queries(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") % 50).alias("query_id")).distinct()


_SIDES = f"""
    s AS (SELECT * FROM ({plain(_SOURCE)}) x), t AS (SELECT * FROM ({plain(_TARGET)}) x),
    q AS (SELECT DISTINCT c_custkey % 50 AS query_id FROM customer),
    c AS (SELECT query_id, (SELECT count(*) FROM s WHERE s.query_id = q.query_id) AS source_rows,
                 (SELECT count(*) FROM t WHERE t.query_id = q.query_id) AS target_rows FROM q),
    ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY Day, K, CASE WHEN kind = 4 THEN NULL ELSE Note END NULLS FIRST, Price) AS rn FROM s),
    pt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY Day, K, CASE WHEN kind = 4 THEN NULL ELSE Note END NULLS FIRST, Price) AS rn FROM t),
    p AS (SELECT ps.query_id, ps.kind, ps.rn - 1 AS "row", ps.K AS sk, pt.K AS tk, ps.Price AS sp, pt.Price AS tp, ps.Day AS sd, pt.Day AS td, ps.Note AS sn, pt.Note AS tn,
            ps.K = pt.K AS k_ok, abs(ps.Price - pt.Price) <= greatest(1e-6, abs(ps.Price) * 1e-6) AS p_ok, ps.Day = pt.Day AS d_ok,
            ps.kind = 4 OR (ps.Note IS NULL AND pt.Note IS NULL) OR coalesce(list_sort(string_split(ps.Note, ', ')) = list_sort(string_split(pt.Note, ', ')), false) AS n_ok
          FROM ps JOIN pt ON ps.query_id = pt.query_id AND ps.rn = pt.rn),
    v AS (SELECT query_id, bool_and(k_ok AND p_ok AND d_ok AND n_ok) AS same, max(kind) AS kind FROM p GROUP BY 1)
    """
_E5 = f"""
    WITH {_SIDES}
    SELECT c.query_id, source_rows = target_rows AND coalesce(same, true) AS match, source_rows = target_rows AS row_count_match,
           source_rows = target_rows AND coalesce(kind, 0) <> 4 AS column_match, source_rows = target_rows AND coalesce(same, true) AS value_match,
           source_rows, target_rows
    FROM c LEFT JOIN v ON v.query_id = c.query_id
    """


@query("E5_compare_results", _E5)
def compare(t: Tables) -> DataFrame:
    return m.compare_results(_result_sets(t), _all_queries(t)).drop("details")


@query(
    "E5_compare_one_large_result",
    """SELECT CAST(1 AS BIGINT) AS query_id, true AS match, true AS row_count_match, true AS column_match, true AS value_match,
              count(*) AS source_rows, count(*) AS target_rows, 'OK' AS details FROM lineitem""",
)
def compare_large(t: Tables) -> DataFrame:
    """One query holds the whole fact table on both sides, and every float differs a little."""
    one = F.lit(1).cast("bigint")
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    lines = spread(t.lineitem.select(*keep, "l_extendedprice"))
    changed = lines.select((F.col("l_extendedprice") * 1.00000001).alias("l_extendedprice"), *keep)
    rows = m.result_rows(lines, one, "source").unionByName(m.result_rows(changed, one, "target"))
    return m.compare_results(rows, t.spark.range(1, 2).withColumnRenamed("id", "query_id"))


@query(
    "E6_mismatch_sample",
    f"""WITH {_SIDES}, cells AS (
          SELECT query_id, "row", 1 AS place, 'k' AS "column", CAST(CAST(sk AS DOUBLE) AS VARCHAR) AS source, CAST(CAST(tk AS DOUBLE) AS VARCHAR) AS target FROM p WHERE NOT k_ok
          UNION ALL SELECT query_id, "row", 2, 'price', CAST(sp AS VARCHAR), CAST(tp AS VARCHAR) FROM p WHERE NOT p_ok
          UNION ALL SELECT query_id, "row", 4, 'note', coalesce('''' || sn || '''', 'None'), coalesce('''' || tn || '''', 'None') FROM p WHERE NOT n_ok)
        SELECT p.query_id, p."row", p."column", CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY "row", place) AS INTEGER) AS nth,
               round(try_cast(source AS DOUBLE), 6) AS source_number, source AS source_text FROM cells p JOIN c ON c.query_id = p.query_id AND source_rows = target_rows
        QUALIFY nth <= 5""",
)
def sample(t: Tables) -> DataFrame:
    rows = _result_sets(t)
    counts = rows.groupBy("query_id").agg(
        F.count_if(F.col("side") == "source").alias("a"), F.count_if(F.col("side") == "target").alias("b")
    )
    equal = cut(counts.filter(F.col("a") == F.col("b")).select("query_id"))

    def names(*given: str) -> Column:
        return F.array(*[F.lit(c) for c in given])

    # the note is renamed on one side of these queries
    odd = F.col("query_id") % 7 == 4
    shared = m.cells_of(names("day", "k", "price"))
    picked = lookup_join(rows, equal, ["query_id"], counted=True).withColumn("cells", F.when(odd, shared).otherwise(F.col("cells")))
    pairs = m.pair_by_position(m.distinct_counts(picked, ["query_id"]), ["query_id"])
    columns = equal.select(
        "query_id",
        F.when(odd, names("day", "k", "price")).otherwise(names("day", "k", "note", "price")).alias("_common"),
        names("k", "price", "day", "note").alias("_source_cols"),
    )
    shown = m.mismatch_sample(m.mismatches(pairs, ["query_id"]), columns, ["query_id"])
    return shown.select(
        "query_id", "row", "column", "nth",
        F.round(F.col("source").try_cast("double"), 6).alias("source_number"), F.col("source").alias("source_text"),
    )


@query(
    "E7_bag_equal",
    f"""WITH {_SIDES}, b AS (
        SELECT query_id, k, price, day, note, col4, sum(n) AS d FROM (
          SELECT query_id, K AS k, Price AS price, Day AS day, Note AS note, 'note' AS col4, 1 AS n FROM s
          UNION ALL SELECT query_id, K, Price, Day, Note, CASE WHEN kind = 4 THEN 'remark' ELSE 'note' END, -1 FROM t) GROUP BY 1, 2, 3, 4, 5, 6)
        SELECT query_id, bool_and(d = 0) AS equal FROM b GROUP BY query_id""",
)
def bags(t: Tables) -> DataFrame:
    return m.bag_equal(_result_sets(t))


@query(
    "E1_normalize_cells",
    """SELECT event_id, 'ts' AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, CAST(NULL AS DOUBLE) AS n FROM events
       UNION ALL SELECT event_id, 'value', NULL, value FROM events UNION ALL SELECT event_id, 'money', NULL, CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) FROM events
       UNION ALL SELECT event_id, 'odd', NULL, CAST(event_id % 2 AS DOUBLE) FROM events UNION ALL SELECT event_id, 'props', props, NULL FROM events
       UNION ALL SELECT event_id, 'raw', props, NULL FROM events UNION ALL SELECT event_id, 'day', strftime(ts, '%Y-%m-%d'), NULL FROM events
       UNION ALL SELECT event_id, 'gone', NULL, NULL FROM events UNION ALL SELECT event_id, 'span', NULL, CAST(event_id AS DOUBLE) FROM events""",
)
def cells(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("ts").alias("TS"),
        "value",
        F.col("value").cast("decimal(10,2)").alias("Money"),
        (F.col("event_id") % 2 == 1).alias("odd"),
        "props",
        F.encode("props", "UTF-8").alias("raw"),
        F.to_date("ts").alias("day"),
        F.lit(None).cast("string").alias("gone"),
        F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)")).alias("span"),
        "event_id",
    )
    result = rows.drop("event_id")
    named = F.arrays_zip(F.array_sort(m.column_names(result)).alias("name"), m.row_sort_key(result).alias("cell"))
    return rows.select("event_id", F.explode(named).alias("c")).select("event_id", "c.name", "c.cell.*")


@query(
    "E2_agg_string_canon",
    """SELECT doc_id, md5(CASE WHEN contains(text, ', ') THEN array_to_string(list_sort(list_transform(string_split(text, ', '), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', ''))), ', ')
         WHEN contains(text, ',') THEN array_to_string(list_sort(list_transform(string_split(text, ','), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', ''))), ',') ELSE text END) AS v FROM documents""",
)
def canon(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(m.agg_string_canon("text")).alias("v"))


def _pairs_of_cells(t: Tables) -> tuple[DataFrame, Column, Column]:
    kind = F.col("l_linenumber")
    price = F.col("l_extendedprice")
    other = F.when(kind == 1, price).when(kind == 2, price * 1.0000001).when(kind == 3, price * 1.001).when(kind == 4, F.lit(None))
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", price.alias("a"), other.otherwise(price + 5e-7).alias("b"),
        F.concat(F.col("l_returnflag"), F.lit(", "), F.col("l_linestatus")).alias("c"),
        F.concat(F.lit(" "), F.col("l_linestatus"), F.lit(", "), F.col("l_returnflag")).alias("d"),
    )

    def cell(c: str) -> Column:
        return m.normalize_cell(c, rows.schema[c].dataType)

    return rows, m.cells_equal(cell("a"), cell("b")), m.cells_equal(cell("c"), cell("d"))


@query(
    "E3_cells_equal",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber NOT IN (3, 4) AS numbers, true AS texts FROM lineitem""",
)
def cells_equal(t: Tables) -> DataFrame:
    rows, numbers, texts = _pairs_of_cells(t)
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", numbers.alias("numbers"), texts.alias("texts"))


@query(
    "E4_row_sort_key",
    """SELECT o_orderkey, 'day=' || strftime(o_orderdate, '%Y-%m-%d') || ' k=' || CAST(o_custkey AS DOUBLE) || ' zone=' || coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, '-') AS v FROM orders""",
)
def sort_key(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("Zone"),
        F.col("o_custkey").alias("K"),
        F.col("o_orderdate").cast("date").alias("Day"),
        "o_orderkey",
    )
    result = rows.drop("o_orderkey")
    named = F.arrays_zip(F.array_sort(m.column_names(result)).alias("name"), m.row_sort_key(result).alias("cell"))
    shown = F.transform(
        named, lambda c: F.concat(c["name"], F.lit("="), F.coalesce(m.cell_text(c["cell"]), F.lit("-")))
    )
    return rows.select("o_orderkey", F.array_join(shown, " ").alias("v"))


# --- pairs, outcomes, scores ----------------------------------------------------------------

_QUERIES = """
    SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 25 = 0 THEN '' ELSE 'db' || CAST(o_custkey % 25 AS STRING) END AS database, o_orderpriority AS difficulty
    FROM {orders}
    """
_TRANSLATED = "SELECT event_id, CAST(floor(event_id / 2) AS BIGINT) AS query_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS translated_sql FROM {events}"
_JOINED = f"""
    WITH s AS ({plain(_QUERIES)}), x AS ({plain(_TRANSLATED)}),
    l AS (SELECT query_id, arg_max(coalesce(translated_sql, ''), event_id) AS translated_sql FROM x GROUP BY 1)
    SELECT s.query_id, database, difficulty, translated_sql FROM s JOIN l ON s.query_id = l.query_id WHERE database <> ''
    """


@query("E8_join_translations", _JOINED)
def joined(t: Tables) -> DataFrame:
    return s.join_translations(t.sql(_QUERIES), t.sql(_TRANSLATED), "event_id")


@query(
    "E8_join_translations_capped",
    _JOINED + " QUALIFY row_number() OVER (PARTITION BY database ORDER BY s.query_id) <= 5",
)
def joined_capped(t: Tables) -> DataFrame:
    """At most five queries per database are evaluated, as asked for by the run's own limit."""
    return s.join_translations(t.sql(_QUERIES), t.sql(_TRANSLATED), "event_id", per_database=5)


_OUTCOMES = """
    SELECT event_id, CAST(floor(value) AS BIGINT) AS row_count, CASE event_type WHEN 'error' THEN 'ERROR: canceling statement due to statement timeout' WHEN 'click' THEN 'ORA-00406: x'
      WHEN 'view' THEN 'Query was Cancelled' WHEN 'signup' THEN repeat('long message ', 60) ELSE '' END AS error FROM {events}
    """


@query(
    "E9_classify_outcome",
    f"""SELECT event_id, CASE WHEN error <> '' THEN 'error' WHEN row_count > 0 THEN 'valid' ELSE 'empty' END AS status,
        CASE WHEN regexp_matches(lower(left(error, 500)), 'timeout|cancelled|maximum execution time') OR contains(left(error, 500), 'ORA-00406') THEN '[TIMEOUT] ' ELSE '' END
          || left(error, 500) AS error FROM ({plain(_OUTCOMES)}) x""",
)
def outcomes(t: Tables) -> DataFrame:
    return t.sql(_OUTCOMES).select(
        "event_id", s.outcome_status("row_count", "error").alias("status"), s.outcome_error("error").alias("error")
    )


@query(
    "E10_infer_direction",
    """SELECT event_id, CASE d WHEN 'mysql' THEN CASE f WHEN 'pg' THEN 'mysql2pg' WHEN 'oracle' THEN 'mysql2oracle' ELSE 'mysql2pg' END
         WHEN 'oracle' THEN CASE f WHEN 'mysql' THEN 'oracle2mysql' WHEN 'pg' THEN 'oracle2pg' ELSE 'oracle2mysql' END
         WHEN 'sqlite' THEN 'mysql2pg' ELSE CASE f WHEN 'mysql' THEN 'pg2mysql' WHEN 'oracle' THEN 'pg2oracle' ELSE 'pg2mysql' END END AS direction
       FROM (SELECT event_id, ['mysql', 'pg', 'oracle', 'postgresql', 'sqlite'][event_id % 5 + 1] AS d,
             ['mysql', 'pg', 'oracle', 'none'][CAST(floor(event_id / 5) AS BIGINT) % 4 + 1] AS f FROM events)""",
)
def directions(t: Tables) -> DataFrame:
    dialects = F.array(*[F.lit(x) for x in ("mysql", "pg", "oracle", "postgresql", "sqlite")])
    files = F.array(*[F.lit(f"/runs/mysql/out_{x}.v1.json") for x in ("MySQL", "pg", "oracle", "none")])
    return t.events.select(
        "event_id",
        s.infer_direction(
            F.get(dialects, (F.col("event_id") % 5).cast("int")),
            F.get(files, (F.floor(F.col("event_id") / 5) % 4).cast("int")),
        ).alias("direction"),
    )


_RUNS = """
    SELECT o_orderkey AS query_id, CASE o_orderkey % 2 WHEN 0 THEN 'mysql2pg' ELSE 'pg2oracle' END AS direction,
           CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'SELECT 1' END AS translated_sql,
           CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'valid' END AS source_status, CASE WHEN o_orderkey % 11 = 0 THEN 'error' ELSE 'empty' END AS target_status,
           CASE WHEN o_orderkey % 7 = 0 THEN 'no table' ELSE '' END AS source_error, CASE WHEN o_orderkey % 11 = 0 THEN 'bad syntax' ELSE '' END AS target_error,
           o_orderstatus <> 'P' AS match, 'seen' AS details FROM {orders}
    """


@query(
    "E11_grade",
    f"""SELECT query_id, 'eval_' || query_id AS eval_id, translated_sql <> '' AS translate_ok, translated_sql <> '' AND source_status <> 'error' AS source_exec_ok,
        translated_sql <> '' AND target_status <> 'error' AS target_exec_ok,
        translated_sql <> '' AND source_status <> 'error' AND target_status <> 'error' AND match AS results_match,
        CASE WHEN translated_sql = '' THEN '' WHEN target_status = 'error' THEN CASE query_id % 2 WHEN 0 THEN 'PostgreSQL' ELSE 'Oracle' END || ' execution failed: bad syntax'
          WHEN source_status = 'error' THEN CASE query_id % 2 WHEN 0 THEN 'MySQL' ELSE 'PostgreSQL' END || ' execution failed: no table' ELSE details END AS comparison_details,
        CASE WHEN translated_sql = '' THEN 'Empty translated SQL' WHEN target_status = 'error' THEN CASE query_id % 2 WHEN 0 THEN 'PostgreSQL' ELSE 'Oracle' END || ' execution error: bad syntax'
          WHEN source_status = 'error' THEN CASE query_id % 2 WHEN 0 THEN 'MySQL' ELSE 'PostgreSQL' END || ' execution error: no table' ELSE '' END AS error
        FROM ({plain(_RUNS)}) x""",
)
def graded(t: Tables) -> DataFrame:
    return s.grade(t.sql(_RUNS)).drop(
        "direction", "translated_sql", "source_status", "target_status", "source_error", "target_error"
    )


@query(
    "E12_score_report",
    f"""WITH g AS ({plain(GRADED)}), a AS (
          SELECT count(*) AS total_queries, count(*) FILTER (WHERE translate_ok) AS translate_ok, count(*) FILTER (WHERE source_exec_ok) AS source_exec_ok,
                 count(*) FILTER (WHERE target_exec_ok) AS target_exec_ok, count(*) FILTER (WHERE results_match) AS results_match FROM g)
        SELECT *, format('{{:.1f}}%', target_exec_ok / total_queries * 100) AS execution_score, format('{{:.1f}}%', results_match / total_queries * 100) AS execution_match,
               results_match / total_queries AS match_rate FROM a""",
)
def report(t: Tables) -> DataFrame:
    return s.score_report(t.sql(GRADED))


@query(
    "E13_score_by_difficulty",
    f"""SELECT coalesce(difficulty, 'unknown') AS difficulty, count(*) AS total, count(*) FILTER (WHERE target_exec_ok) AS target_ok,
        count(*) FILTER (WHERE results_match) AS match FROM ({plain(GRADED)}) g GROUP BY 1""",
)
def by_difficulty(t: Tables) -> DataFrame:
    return s.score_by(t.sql(GRADED), "difficulty")


@query(
    "E13_score_by_database",
    f"SELECT database, count(*) AS total, count(*) FILTER (WHERE results_match) AS match FROM ({plain(GRADED)}) g GROUP BY 1",
)
def by_database(t: Tables) -> DataFrame:
    return s.score_by(t.sql(GRADED), "database").drop("target_ok")


@query(
    "E14_failure_sample",
    f"""SELECT eval_id, query_id, difficulty, database, error, comparison_details FROM ({plain(GRADED)}) g WHERE NOT results_match
        ORDER BY query_id LIMIT 20""",
)
def failures(t: Tables) -> DataFrame:
    return s.failure_sample(t.sql(GRADED), [F.col("query_id")], 20)


# Pairs made from the suppliers: a database per nation with its own share of the orders. By
# id: equal texts, one order more in every fourth database, the clock, random numbers, a missing table and a
# text without translation.
_PAIRS = """
    SELECT concat('db', s_nationkey) AS database, s_suppkey AS query_id, 'easy' AS difficulty,
           CASE s_suppkey % 6 WHEN 3 THEN 'pg2mysql' ELSE 'mysql2pg' END AS direction,
           CASE s_suppkey % 6
             WHEN 0 THEN 'SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1'
             WHEN 1 THEN 'SELECT count(*) AS n FROM orders'
             WHEN 2 THEN 'SELECT NOW() AS t, count(*) AS n FROM orders'
             WHEN 3 THEN 'SELECT RANDOM() AS r, max(o_orderkey) AS k FROM orders'
             ELSE 'SELECT 1 AS one' END AS source_sql,
           CASE s_suppkey % 6
             WHEN 0 THEN 'SELECT count(1) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus'
             WHEN 1 THEN concat('SELECT count(*) + ', CASE s_nationkey % 4 WHEN 1 THEN '1' ELSE '0' END, ' AS n FROM orders')
             WHEN 2 THEN 'SELECT cast(CURRENT_TIMESTAMP AS string) AS t, count(*) AS n FROM orders'
             WHEN 3 THEN 'SELECT RAND() AS r, max(o_orderkey) AS k FROM orders'
             WHEN 4 THEN 'SELECT 1 AS one FROM no_such_table'
             ELSE '' END AS translated_sql
    FROM {supplier}"""


@query(
    "E15_evaluate_pairs",
    """SELECT 'db' || s_nationkey AS database, s_suppkey AS query_id, s_suppkey % 6 < 5 AS translate_ok,
              s_suppkey % 6 < 5 AS source_exec_ok, s_suppkey % 6 < 4 AS target_exec_ok,
              s_suppkey % 6 < 4 AND NOT (s_suppkey % 6 = 1 AND s_nationkey % 4 = 1) AS results_match
       FROM supplier""",
)
def evaluate(t: Tables) -> DataFrame:
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/pairs-{t.spark.sql('SELECT uuid()').first()[0]}"
    # Orders are dealt out once: a query then reads its own database, in as many tasks as that has files.
    dealt = t.orders.withColumn("_database", F.col("o_custkey") % 25).hint("rebalance", "_database")
    dealt.write.partitionBy("_database").parquet(f"{folder}/orders")
    shape = T.StructType([*t.orders.schema.fields, T.StructField("_database", dealt.schema["_database"].dataType)])
    stored = t.spark.read.schema(shape).parquet(f"{folder}/orders")
    files = Counter(f.rpartition("/")[0].rpartition("=")[2] for f in stored.inputFiles())
    held: list[DataFrame] = []

    def open_database(session: SparkSession, database: str) -> None:
        orders = session.read.schema(shape).parquet(f"{folder}/orders").filter(F.col("_database") == int(database[2:]))
        tasks = max(1, files[database[2:]])
        # What AQE would find out by jobs of their own for each query is known from the files.
        session.conf.set("spark.sql.adaptive.enabled", "false")
        session.conf.set("spark.sql.shuffle.partitions", str(tasks))
        held.append(orders.drop("_database").coalesce(tasks).persist())
        held[-1].createOrReplaceTempView("orders")

    try:
        results, _ = s.evaluate_pairs(t.spark, t.sql(_PAIRS), folder, timeout=300, open_database=open_database)
    finally:
        for orders in held:
            orders.unpersist()
    return results.select("database", "query_id", "translate_ok", "source_exec_ok", "target_exec_ok", "results_match")


# --- bookkeeping -----------------------------------------------------------------------------

_VALIDATED = """
    SELECT 'db' || CAST(o_custkey % 25 AS STRING) AS database, CASE o_orderpriority WHEN '1-URGENT' THEN 'extra' WHEN '2-HIGH' THEN 'hard' WHEN '3-MEDIUM' THEN 'medium' ELSE 'easy' END AS difficulty,
           CASE o_orderstatus WHEN 'O' THEN 'valid' WHEN 'F' THEN 'empty' ELSE 'error' END AS status,
           CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey % 2 = 0 END AS fixed FROM {orders}
    """


@query(
    "E16_validation_stats",
    "SELECT database, count(*) AS total_queries, "
    + ", ".join(f"count(*) FILTER (WHERE difficulty = '{x}') AS n_{x}" for x in ("easy", "medium", "hard", "extra"))
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("valid", "empty", "error"))
    + f", count(*) FILTER (WHERE fixed) AS repaired, count(*) FILTER (WHERE NOT fixed) AS repair_failed FROM ({plain(_VALIDATED)}) v GROUP BY 1",
)
def validation(t: Tables) -> DataFrame:
    return s.validation_stats(t.sql(_VALIDATED))


_STATS = """
    SELECT 'db' || CAST(o_custkey AS STRING) AS db, count(*) AS total_queries, count(DISTINCT o_orderpriority) AS gen_tokens
    FROM {{orders}} WHERE o_orderstatus = '{}' GROUP BY 1
    """
_OLD, _NEW = _STATS.format("F"), _STATS.format("P")


@query(
    "E17_merge_stats",
    f"""WITH o AS ({plain(_OLD)}), n AS ({plain(_NEW)}) SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n ON o.db = n.db""",
)
def merged(t: Tables) -> DataFrame:
    return s.merge_stats(t.sql(_OLD), t.sql(_NEW), "db")


@query(
    "E17_stats_totals",
    f"""WITH o AS ({plain(_OLD)}), n AS ({plain(_NEW)}), m AS (SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n ON o.db = n.db)
        SELECT count(*) AS total_databases, CAST(sum(total_queries) AS BIGINT) AS total_total_queries, CAST(sum(gen_tokens) AS BIGINT) AS total_gen_tokens FROM m""",
)
def totals(t: Tables) -> DataFrame:
    return s.stats_totals(s.merge_stats(t.sql(_OLD), t.sql(_NEW), "db"), ["total_queries", "gen_tokens"])


@query(
    "E18_usage_cost",
    """WITH u AS (SELECT l_returnflag AS model, CAST(round(l_extendedprice) AS BIGINT) AS i, CAST(l_quantity AS BIGINT) AS o, CAST(l_quantity AS BIGINT) * 10 * (l_linenumber % 2) AS h,
                         CASE WHEN l_returnflag = 'R' THEN NULL ELSE 0.0001 END AS p, l_linenumber AS n FROM lineitem)
       SELECT model, round(sum(CAST(CAST((CASE WHEN h > 0 AND p IS NOT NULL THEN h / 1000 * CAST(p AS DOUBLE) + (i - h) / 1000 * 0.001::DOUBLE ELSE i / 1000 * 0.001::DOUBLE END
         + o / 1000 * 0.002::DOUBLE) / n AS DECIMAL(20,10)) AS DECIMAL(20,10))), 6)::DOUBLE AS cost FROM u GROUP BY 1""",
)
def usage(t: Tables) -> DataFrame:
    tokens = F.col("l_quantity").cast("bigint")
    price = F.when(F.col("l_returnflag") != "R", F.lit(0.0001))
    cost = s.usage_cost(
        F.round("l_extendedprice").cast("bigint"), tokens, tokens * 10 * (F.col("l_linenumber") % 2),
        F.lit(0.001), F.lit(0.002), price, F.col("l_linenumber"),
    )
    return t.lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(
        F.round(F.sum(cost.cast("decimal(20,10)")), 6).cast("double").alias("cost")
    )


_PROGRESS = """
    SELECT c_custkey, c_nationkey % 3 <> 0 AS verification_passed, c_custkey % 4 <> 0 AS db_test_passed, CASE WHEN c_custkey % 50 = 0 THEN 'x' ELSE '' END AS error, c_custkey AS total_tokens
    FROM {customer}
    """


@query(
    "E19_progress_rollup",
    f"""SELECT count(*) AS total_processed, count(*) FILTER (WHERE verification_passed) AS llm_passed, count(*) FILTER (WHERE db_test_passed) AS db_test_passed,
        count(*) FILTER (WHERE verification_passed AND db_test_passed) AS both_passed, count(*) FILTER (WHERE NOT (verification_passed AND db_test_passed)) AS failed,
        count(*) FILTER (WHERE error <> '') AS errors, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM ({plain(_PROGRESS)}) x""",
)
def progress(t: Tables) -> DataFrame:
    return s.progress_rollup(t.sql(_PROGRESS))


_OUTPUTS = "SELECT o_custkey AS db, CASE o_orderkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'pg' ELSE 'oracle' END AS dialect FROM {orders}"


@query(
    "E20_pending",
    f"""SELECT c_custkey AS db FROM customer WHERE c_custkey NOT IN (
          SELECT db FROM ({plain(_OUTPUTS)}) o GROUP BY 1 HAVING count(DISTINCT dialect) = 3
          INTERSECT SELECT c_custkey FROM ({plain(_PROGRESS)}) p WHERE verification_passed AND db_test_passed)""",
)
def pending(t: Tables) -> DataFrame:
    checks = t.sql(_PROGRESS).withColumnRenamed("c_custkey", "db")
    return s.pending(t.customer.select(F.col("c_custkey").alias("db")), t.sql(_OUTPUTS), checks)



@query(
    "E3_number_digits",
    """SELECT p_partkey, CAST(CAST(p_partkey + 1 AS DOUBLE) / 8192 AS VARCHAR) AS small, CAST(CAST(p_partkey AS DOUBLE) * 1048576 + 0.5 AS VARCHAR) AS large,
              true AS same FROM part""",
)
def number_digits(t: Tables) -> DataFrame:
    small = (F.col("p_partkey") + 1).cast("double") / 8192

    def cell(s: Column, n: Column) -> Column:
        return F.struct(s.cast("string").alias("s"), n.cast("double").alias("n"))

    text = m.number_text(small)
    return t.part.select(
        "p_partkey",
        text.alias("small"),
        m.number_text(F.col("p_partkey").cast("double") * 1048576 + 0.5).alias("large"),
        m.cells_equal(cell(F.lit(None), small), cell(text, F.lit(None))).alias("same"),
    )
