"""Profiling and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilect.operators import catalog as c
from trilect.operators import profile as p
from trilect.plans.derived import CATALOG, CATALOG_FLAGS, DIFFERENCES
from trilect.plans.registry import Tables, plain, query


@query(
    "P1_sample_rows",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS text,
              coalesce(CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END, 'NULL') AS lang
       FROM documents ORDER BY documents.doc_id LIMIT 5""",
)
def sample_rows(t: Tables) -> DataFrame:
    lang = F.when(F.col("doc_id") % 2 != 0, F.col("lang")).alias("lang")
    return p.sample_rows(t.documents.select("doc_id", "text", lang), [F.col("doc_id")], 5)


@query(
    "P2_minmax_profile",
    """SELECT 'l_quantity' AS column_name, 'DECIMAL' AS data_type, CAST(min(l_quantity) AS VARCHAR) AS min_value,
              CAST(max(l_quantity) AS VARCHAR) AS max_value FROM lineitem
       UNION ALL SELECT 'l_shipdate', 'DATE', CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR), CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) FROM lineitem
       UNION ALL SELECT 'l_linenumber', 'INT', CAST(min(l_linenumber) AS VARCHAR), CAST(max(l_linenumber) AS VARCHAR) FROM lineitem""",
)
def minmax(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_quantity", F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_linenumber",
        F.lit(None).cast("int").alias("never"),
    )
    types = {"l_quantity": "DECIMAL", "l_shipdate": "DATE", "l_linenumber": "INT", "never": "INT"}
    return p.minmax_profile(rows, types)


_STRATA = """
    SELECT event_id, CASE event_type WHEN 'signup' THEN 'function' WHEN 'error' THEN 'function' WHEN 'view' THEN 'keyword'
           WHEN 'click' THEN 'operator' ELSE 'type' END AS kind FROM {events}
    """


@query(
    "P3_stratified_sample",
    f"""WITH x AS ({plain(_STRATA)}), q AS (
          SELECT kind, greatest(1, CAST(round_even(count(*) / (SELECT count(*) FROM x) * 60, 0) AS INTEGER)) AS quota FROM x GROUP BY 1),
        r AS (SELECT x.*, md5(event_id || ':7') AS h, row_number() OVER (PARTITION BY kind ORDER BY md5(event_id || ':7'), event_id) AS rn FROM x),
        s AS (SELECT r.* FROM r JOIN q ON q.kind = r.kind WHERE rn <= quota ORDER BY h, event_id LIMIT 60)
        SELECT event_id, kind, CAST(CASE kind WHEN 'function' THEN 0 WHEN 'keyword' THEN 1 WHEN 'operator' THEN 2 ELSE 3 END AS INTEGER) AS priority
        FROM s""",
)
def stratified(t: Tables) -> DataFrame:
    taken = p.stratified_sample(t.sql(_STRATA), "kind", "event_id", 60, 7)
    return taken.withColumn("priority", p.priority_of("kind")).orderBy("priority", "event_id")


@query(
    "P4_simple_sample",
    "SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT 50",
)
def simple(t: Tables) -> DataFrame:
    return p.simple_sample(t.part.select("p_partkey", "p_name"), "p_partkey", 50, 42)


_LEVELS = """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'extra' WHEN '2-HIGH' THEN 'hard' WHEN '3-MEDIUM' THEN 'medium'
           ELSE 'easy' END AS difficulty FROM {orders}
    """
_WEIGHTS = {"easy": 0.1, "medium": 0.3, "hard": 0.4, "extra": 0.2}


@query(
    "P5_weighted_quota_sample",
    f"""SELECT o_orderkey, difficulty FROM ({plain(_LEVELS)}) x QUALIFY row_number() OVER
        (PARTITION BY difficulty ORDER BY md5(o_orderkey || ':3'), o_orderkey)
        <= CASE difficulty WHEN 'easy' THEN 2 WHEN 'medium' THEN 6 WHEN 'hard' THEN 8 ELSE 4 END""",
)
def weighted(t: Tables) -> DataFrame:
    return p.weighted_quota_sample(t.sql(_LEVELS), "difficulty", "o_orderkey", _WEIGHTS, 2, 3)


@query(
    "P6_coverage_allocate",
    """WITH i AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || ':1042'), p_partkey) AS i FROM part),
       t AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || ':1042'), c_custkey) AS t FROM customer)
       SELECT c_custkey, p_partkey FROM t CROSS JOIN generate_series(0, 2) AS g(k)
       JOIN i ON i.i = ((t.t - 1) * 3 + k) % (SELECT count(*) FROM part) + 1""",
)
def coverage(t: Tables) -> DataFrame:
    seed = 42 + p.SPLIT_SEED_OFFSET["dev"]
    return p.coverage_allocate(
        t.part.select("p_partkey"), "p_partkey", t.customer.select("c_custkey"), "c_custkey", 3, 2, seed
    )


@query(
    "P7_discover",
    """SELECT k, CASE WHEN user_id IS NULL THEN 'missing' ELSE 'present' END AS status
       FROM (SELECT DISTINCT o_custkey AS k FROM orders) LEFT JOIN (SELECT DISTINCT user_id FROM events) ON user_id = k""",
)
def discover(t: Tables) -> DataFrame:
    return p.discover(
        t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k")), "k"
    )


@query(
    "P8_existing_value_digest",
    """WITH v AS (SELECT 'p_name' AS field, trim(p_name) AS v FROM part UNION SELECT 'p_brand', trim(p_brand) FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY v) AS rn FROM v WHERE v <> '')
       SELECT field, (SELECT count(*) FROM part) AS row_count, (SELECT max(p_partkey) FROM part) AS max_id,
              (SELECT max(p_partkey) + 1 FROM part) AS next_id, count(*) AS n_distinct,
              string_agg(v, ', ' ORDER BY v) FILTER (WHERE rn <= 30) AS shown FROM r GROUP BY field""",
)
def digest(t: Tables) -> DataFrame:
    return p.existing_value_digest(t.part, "p_partkey", ["p_name", "p_brand"])


@query(
    "P9_table_summary",
    f"""WITH c AS ({plain(CATALOG)}), f AS ({CATALOG_FLAGS}),
        k AS (SELECT db, table_name, ordinal, column_name, unnest(classes) AS type_class FROM f)
        SELECT db, table_name, type_class, count(*) AS n_columns, string_agg(column_name, ', ' ORDER BY ordinal) AS columns
        FROM k WHERE type_class <> '' GROUP BY 1, 2, 3""",
)
def summary(t: Tables) -> DataFrame:
    return c.table_summary(t.sql(CATALOG))


@query(
    "P10_pick_entity_tables",
    f"""WITH c AS ({plain(CATALOG)}), f AS ({CATALOG_FLAGS})
        SELECT db, table_name, count(*) FILTER (WHERE NOT is_pk AND NOT is_fk) AS n_plain,
               count(*) FILTER (WHERE NOT is_fk AND list_contains(classes, 'string')) AS n_text
        FROM f GROUP BY 1, 2 HAVING n_plain > 0 AND n_text > 0""",
)
def entity_tables(t: Tables) -> DataFrame:
    return c.pick_entity_tables(t.sql(CATALOG))


@query(
    "P11_pick_dedup_fields",
    f"""WITH c AS ({plain(CATALOG)}), f AS ({CATALOG_FLAGS}),
        s AS (SELECT *, CASE WHEN column_name IN ('name', 'title') THEN 1
                             WHEN NOT is_pk AND regexp_matches(column_name, 'name|title|school|label|description') THEN 2
                             WHEN NOT is_pk THEN 3 END AS tier
              FROM f WHERE list_contains(classes, 'string')),
        b AS (SELECT *, min(tier) OVER w AS best, min(ordinal) OVER w AS first FROM s WHERE tier IS NOT NULL WINDOW w AS (PARTITION BY db, table_name))
        SELECT db, table_name, ordinal, column_name, CAST(tier AS INTEGER) AS tier FROM b
        WHERE tier = best AND (tier < 3 OR ordinal = first)""",
)
def dedup_fields(t: Tables) -> DataFrame:
    return c.pick_dedup_fields(t.sql(CATALOG))


_ASSIGNED = "SELECT DISTINCT l_suppkey AS db, 'DIFF_' || CAST(l_partkey AS STRING) AS diff_id FROM {lineitem}"


@query(
    "P12_requirements_for",
    f"""WITH a AS ({plain(_ASSIGNED)}), d AS ({plain(DIFFERENCES)}),
        r AS (SELECT id, feature, category, 'query_requirements' AS kind, generate_subscripts(qr, 1) - 1 AS ordinal, unnest(qr) AS requirement FROM d
              UNION ALL SELECT id, feature, category, 'query_patterns', generate_subscripts(qp, 1) - 1, unnest(qp) FROM d)
        SELECT db, diff_id, feature, category, kind, CAST(ordinal AS INTEGER) AS ordinal, requirement FROM a JOIN r ON id = diff_id""",
)
def requirements(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    differences = t.sql(DIFFERENCES).select(
        "id",
        "feature",
        "category",
        F.struct(
            F.col("qr").alias("query_requirements"),
            F.col("qp").alias("query_patterns"),
            none.alias("data_requirements"),
            none.alias("schema_requirements"),
        ).alias("test_requirements"),
    )
    return p.requirements_for(t.sql(_ASSIGNED), differences)


@query(
    "IO3_read_table",
    "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderkey) AS top FROM orders",
)
def read_orders(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.max("o_orderkey").alias("top")
    )
