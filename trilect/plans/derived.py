"""Inputs derived from the tables, as SQL text that Spark and the checking engine both read.

Catalogs, DDL files, query texts and result sets are not among the tables; each
is spelled out here so that its size follows the table it comes from.
"""

from __future__ import annotations

# One catalog column per part: twenty columns a table, ten tables a database.
CATALOG = """
    SELECT 'db' || CAST(CAST(floor(p_partkey / 200) AS BIGINT) AS STRING) AS db,
           't' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) AS table_name,
           CAST(p_partkey % 20 AS INT) + 1 AS ordinal,
           CASE WHEN p_partkey % 20 = 0 THEN 'id'
                WHEN p_partkey % 20 = 3 AND p_size % 2 = 0 THEN 'name'
                WHEN p_partkey % 20 = 4 AND p_size % 3 = 0 THEN 'title'
                WHEN p_partkey % 20 = 5 AND p_size % 3 = 0 THEN 'school_code'
                ELSE replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 20 AS STRING) END AS column_name,
           CASE WHEN p_partkey % 20 < 3 THEN 'INT'
                WHEN p_size % 13 = 0 THEN 'VARCHAR(' || CAST(p_size AS STRING) || ')' WHEN p_size % 13 = 1 THEN 'TEXT'
                WHEN p_size % 13 = 2 THEN 'INT' WHEN p_size % 13 = 3 THEN 'DECIMAL(10,2)' WHEN p_size % 13 = 4 THEN 'DATE'
                WHEN p_size % 13 = 5 THEN 'TIMESTAMP' WHEN p_size % 13 = 6 THEN 'TINYINT(1)' WHEN p_size % 13 = 7 THEN 'JSON'
                WHEN p_size % 13 = 8 THEN 'NUMBER(10)' WHEN p_size % 13 = 9 THEN 'NUMBER(10,2)' WHEN p_size % 13 = 10 THEN 'BLOB'
                WHEN p_size % 13 = 11 THEN 'CHAR(10)' ELSE 'TEXT[]' END AS data_type,
           (p_size % 3 = 0 AND p_partkey % 20 > 2) AS nullable,
           (p_partkey % 20 = 0 OR (p_partkey % 20 = 1 AND floor(p_partkey / 20) % 4 = 0)) AS is_pk,
           (p_partkey % 20 = 1 OR p_partkey % 20 = 2 OR (p_partkey % 20 = 0 AND floor(p_partkey / 20) % 8 = 0)) AS is_fk,
           (p_partkey % 20 = 0) AS is_auto
    FROM {part}
    """

# For the checking engine: the catalog ``c`` with its type classes as a list.
CATALOG_CLASSES = """list_filter([
    CASE WHEN regexp_matches(data_type, '^(VARCHAR|CHAR|TEXT$)') THEN 'string' END,
    CASE WHEN regexp_matches(data_type, '^(INT$|TINYINT|NUMBER\\(10\\)$)') THEN 'integer' END,
    CASE WHEN regexp_matches(data_type, '^(DECIMAL|NUMBER\\(10,2\\))') THEN 'decimal' END,
    CASE WHEN regexp_matches(data_type, '^(DATE|TIMESTAMP)') THEN 'date' END,
    CASE WHEN regexp_matches(data_type, '^TINYINT') THEN 'boolean' END,
    CASE WHEN data_type = 'JSON' THEN 'json' END,
    CASE WHEN data_type = 'BLOB' THEN 'binary' END,
    CASE WHEN data_type LIKE '%[]' THEN 'array' END], lambda x: x IS NOT NULL)"""
CATALOG_FLAGS = f"SELECT *, list_concat({CATALOG_CLASSES}, CASE WHEN nullable AND NOT is_pk THEN ['nullable'] ELSE [] END) AS classes FROM c"

DIFFERENCES = """
    SELECT 'DIFF_' || CAST(p_partkey AS STRING) AS id, upper(replace(p_name, ' ', '_')) AS feature, p_type AS category,
           split(p_name, ' ') AS qr, split(p_brand, '#') AS qp FROM {part}
    """

# Twenty-five databases of numbered tables; table i refers to i/2 and i/3, every
# tenth to itself, and tables 7 and 8 of the first databases to each other.
FK_TABLES = """
    SELECT 'd' || CAST(c_custkey % 25 AS STRING) AS db, 't' || CAST(CAST(floor(c_custkey / 25) AS BIGINT) AS STRING) AS table_name
    FROM {customer}
    """
_I = "CAST(floor(c_custkey / 25) AS BIGINT)"
_DB = "'d' || CAST(c_custkey % 25 AS STRING)"
FK_EDGES = f"""
    SELECT {_DB} AS db, 't' || CAST({_I} AS STRING) AS table_name, 't' || CAST(CAST(floor({_I} / 2) AS BIGINT) AS STRING) AS ref_table
    FROM {{customer}} WHERE {_I} > 0
    UNION ALL
    SELECT {_DB}, 't' || CAST({_I} AS STRING), 't' || CAST(CAST(floor({_I} / 3) AS BIGINT) AS STRING) FROM {{customer}} WHERE {_I} > 1
    UNION ALL
    SELECT {_DB}, 't' || CAST({_I} AS STRING), 't' || CAST({_I} AS STRING) FROM {{customer}} WHERE {_I} % 10 = 0
    UNION ALL
    SELECT {_DB}, 't' || CAST({_I} AS STRING), 't' || CAST(15 - {_I} AS STRING) FROM {{customer}}
    WHERE {_I} BETWEEN 7 AND 8 AND c_custkey % 25 < 5
    """
FK_LEVELS_ORACLE = """
    WITH RECURSIVE n AS (SELECT DISTINCT * FROM ({nodes}) x),
    e AS (SELECT DISTINCT a.* FROM ({edges}) a JOIN n ON n.db = a.db AND n.table_name = a.ref_table WHERE a.table_name <> a.ref_table),
    bad AS (
      SELECT a.db, a.table_name FROM e a JOIN e b ON a.db = b.db AND a.table_name = b.ref_table AND a.ref_table = b.table_name
      UNION SELECT e.db, e.table_name FROM e JOIN bad ON e.db = bad.db AND e.ref_table = bad.table_name),
    lv AS (
      SELECT n.db, n.table_name, 0 AS level FROM n ANTI JOIN e ON e.db = n.db AND e.table_name = n.table_name
      UNION
      SELECT e.db, e.table_name, lv.level + 1 FROM e JOIN lv ON e.db = lv.db AND e.ref_table = lv.table_name
      WHERE (e.db, e.table_name) NOT IN (SELECT (db, table_name) FROM bad)),
    good AS (SELECT db, table_name, max(level) AS level FROM lv GROUP BY 1, 2),
    last AS (SELECT db, max(level) + 1 AS level FROM good GROUP BY 1)
    """

# Query texts, one per order.
QUERY_TEXTS = """
    SELECT o_orderkey AS query_id,
           CASE o_orderkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'pg' ELSE 'oracle' END AS dialect,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'extra' WHEN '2-HIGH' THEN 'hard' WHEN '3-MEDIUM' THEN 'medium' ELSE 'easy' END
             AS difficulty,
           '-- order ' || CAST(o_orderkey AS STRING) || chr(10) ||
           CASE o_orderkey % 3
             WHEN 0 THEN CASE CAST(floor(o_orderkey / 3) AS BIGINT) % 4
               WHEN 0 THEN 'SELECT now( ), CURDATE() AS current_date FROM t WHERE a < CURRENT_DATE'
               WHEN 1 THEN 'SELECT Current_Timestamp(), RAND(3) FROM t ORDER BY rand()'
               WHEN 2 THEN '# note' || chr(10) || 'SELECT SYSDATE() /* when */ AS s, UTC_DATE();;'
               ELSE 'SELECT brand, a LIKE b FROM t GROUP BY brand; DELETE FROM t' END
             WHEN 1 THEN CASE CAST(floor(o_orderkey / 3) AS BIGINT) % 3
               WHEN 0 THEN 'SELECT NOW(), CURRENT_DATE - 1 AS current_date, LOCALTIME FROM t'
               WHEN 1 THEN 'SELECT current_time, random() FROM t WHERE x = LOCALTIMESTAMP;'
               ELSE 'SELECT a ~ b FROM t /* one' || chr(10) || 'two */ ;' END
             ELSE CASE CAST(floor(o_orderkey / 3) AS BIGINT) % 3
               WHEN 0 THEN 'SELECT SYSDATE, DBMS_RANDOM.VALUE(1, 10) FROM dual'
               WHEN 1 THEN 'SELECT SYSTIMESTAMP, dbms_random.value FROM dual' || chr(10) || '  -- end'
               ELSE 'SELECT CURRENT_DATE, DBMS_RANDOM.RANDOM FROM dual HAVING 1 = 1' END
           END || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'LIMIT ' || CAST(o_custkey AS STRING) ELSE '' END AS sql
    FROM {orders}
    """

# Graded pairs, one per order.
GRADED = """
    SELECT 'eval_' || CAST(o_orderkey AS STRING) AS eval_id, o_orderkey AS query_id,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'extra' ELSE 'easy' END AS difficulty,
           'db' || CAST(o_custkey % 25 AS STRING) AS database,
           o_orderkey % 20 <> 0 AS translate_ok, o_orderkey % 20 <> 0 AND o_orderkey % 7 <> 0 AS source_exec_ok,
           o_orderkey % 20 <> 0 AND o_orderkey % 11 <> 0 AS target_exec_ok,
           o_orderkey % 20 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderstatus <> 'P' AS results_match,
           CASE WHEN o_orderkey % 20 = 0 THEN 'Empty translated SQL' WHEN o_orderkey % 11 = 0 THEN 'PostgreSQL execution error: x'
                ELSE '' END AS error,
           CASE WHEN o_orderstatus = 'P' THEN 'Value mismatch' ELSE 'OK' END AS comparison_details
    FROM {orders}
    """
