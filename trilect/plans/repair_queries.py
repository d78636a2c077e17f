"""Table-quality queries: keys, duplicates, references, types, required values, generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilect.operators import catalog as c
from trilect.operators import repair as r
from trilect.operators.ordering import lookup_join
from trilect.plans.derived import CATALOG, CATALOG_FLAGS
from trilect.plans.registry import Tables, plain, query

_OLD_IDS = "SELECT o_orderkey, o_custkey * 10 + 3 AS id FROM {orders}"


@query(
    "R1_remap_keys",
    f"""SELECT id AS old_id, row_number() OVER (ORDER BY min(o_orderkey), id) + 1000000 AS new_id
        FROM ({plain(_OLD_IDS)}) x GROUP BY id""",
)
def remap_keys(t: Tables) -> DataFrame:
    return r.remap_keys(t.sql(_OLD_IDS), "id", F.col("o_orderkey"), 1000001)


@query(
    "R2_remap_fks",
    """WITH m AS (SELECT o_orderkey AS old_id, row_number() OVER (ORDER BY o_orderkey) + 1000000 AS new_id FROM orders WHERE o_orderstatus = 'O')
       SELECT coalesce(new_id, l_orderkey) AS l_orderkey, l_linenumber, l_partkey FROM lineitem LEFT JOIN m ON old_id = l_orderkey""",
)
def remap_fks(t: Tables) -> DataFrame:
    mapping = r.remap_keys(t.orders.filter(F.col("o_orderstatus") == "O"), "o_orderkey", F.col("o_orderkey"), 1000001)
    return r.remap_fks(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", mapping)


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query(
    "R3_dedup_pk",
    f"""SELECT {", ".join(_LINE)} FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_LINE[2:])}) = 1""",
)
def dedup_pk(t: Tables) -> DataFrame:
    return r.dedup_pk(t.lineitem.select(*_LINE), _LINE[:2], [F.col(x) for x in _LINE[2:]])


_BLANKS = """
    SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN ' ' WHEN p_partkey % 50 = 1 THEN NULL WHEN p_partkey % 2 = 0 THEN upper(p_name)
           ELSE p_name || ' ' END AS name FROM {part}
    """


@query(
    "R4_dedup_content",
    f"""SELECT p_partkey, name FROM ({plain(_BLANKS)}) x
        QUALIFY trim(coalesce(name, '')) = '' OR row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY p_partkey) = 1""",
)
def dedup_content(t: Tables) -> DataFrame:
    return r.dedup_content(t.sql(_BLANKS), ["name"], "p_partkey")


@query(
    "R4_dedup_content_two_fields",
    """WITH RECURSIVE r AS (SELECT p_partkey, p_name || ' ' || p_type AS title, p_brand || ' ' || p_size AS short_name,
                                  row_number() OVER (ORDER BY p_partkey) AS i FROM part),
       w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS ss, CAST(NULL AS BIGINT) AS kept
             UNION ALL
             SELECT r.i, CASE WHEN ok THEN list_append(ts, lower(title)) ELSE ts END, CASE WHEN ok THEN list_append(ss, lower(short_name)) ELSE ss END,
                    CASE WHEN ok THEN p_partkey END
             FROM (SELECT r.*, ts, ss, NOT list_contains(ts, lower(title)) AND NOT list_contains(ss, lower(short_name)) AS ok
                   FROM w JOIN r ON r.i = w.i + 1) r)
       SELECT p_partkey, title, short_name FROM r JOIN w ON kept = p_partkey""",
)
def dedup_two_fields(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("short_name"),
    )
    return r.dedup_content(rows, ["title", "short_name"], "p_partkey")


@query(
    "R5_is_bridge",
    f"""WITH c AS ({plain(CATALOG)}) SELECT db, table_name,
        count(*) FILTER (WHERE is_pk) >= 2 AND count(*) FILTER (WHERE is_pk AND NOT is_fk) = 0 AS is_bridge FROM c GROUP BY 1, 2""",
)
def is_bridge(t: Tables) -> DataFrame:
    return c.is_bridge(t.sql(CATALOG))


_CUSTOMER_GAPS = """
    SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN ' ' ELSE c_name END AS c_name, c_mktsegment
    FROM {customer}
    """


@query("R6_drop_empty_core", f"SELECT * FROM ({plain(_CUSTOMER_GAPS)}) x WHERE trim(coalesce(c_name, '')) <> ''")
def drop_empty_core(t: Tables) -> DataFrame:
    return r.drop_empty_core(t.sql(_CUSTOMER_GAPS), "c_name")


@query(
    "R6_core_column",
    f"""WITH c AS ({plain(CATALOG)}), f AS ({CATALOG_FLAGS})
        SELECT db, table_name, arg_min(column_name, ordinal) AS core_column FROM f
        WHERE NOT is_pk AND NOT is_fk AND list_contains(classes, 'string') GROUP BY 1, 2""",
)
def core_column(t: Tables) -> DataFrame:
    return c.core_column(t.sql(CATALOG))


_ORPHANS = """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice,
           CASE WHEN l_linenumber = 6 THEN NULL ELSE l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END END AS l_partkey
    FROM {lineitem}
    """
_ROW_KEY = ["l_orderkey", "l_linenumber", "l_suppkey", "_cents"]


@query(
    "R7_fix_fks",
    f"""WITH x AS ({plain(_ORPHANS)}), p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS at FROM part),
        k AS (SELECT x.*, p_partkey IS NOT NULL AS ok,
                CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_suppkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT)), 1, 15) AS BIGINT)
                  % (SELECT count(*) FROM part) + 1 AS pick
              FROM x LEFT JOIN part ON p_partkey = l_partkey)
        SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice,
               CASE WHEN l_partkey IS NULL OR ok THEN l_partkey ELSE p.p_partkey END AS l_partkey
        FROM k JOIN p ON p.at = pick""",
)
def fix_fks(t: Tables) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100, 0).cast("bigint").alias("_cents")
    fixed = r.fix_fks(t.sql(_ORPHANS).select("*", cents), "l_partkey", t.part, "p_partkey", _ROW_KEY)
    return fixed.drop("_cents")


@query(
    "R8_fk_report",
    f"""WITH x AS ({plain(_ORPHANS)})
        SELECT 'l_partkey' AS fk, count(*) AS invalid FROM x WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'l_orderkey', count(*) FROM x WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'l_suppkey', count(*) FROM x WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def fk_report(t: Tables) -> DataFrame:
    relations = {
        "l_partkey": (t.part, "p_partkey"),
        "l_orderkey": (t.orders, "o_orderkey"),
        "l_suppkey": (t.supplier, "s_suppkey"),
    }
    return r.fk_report(t.sql(_ORPHANS), relations)


@query(
    "R9_fix_unique_text",
    """WITH x AS (SELECT p_partkey, p_name AS v, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)
       SELECT p_partkey, v AS v_old, CASE WHEN rn = 1 THEN v ELSE v || '_' || (rn + 998) END AS v FROM x""",
)
def unique_text(t: Tables) -> DataFrame:
    return r.fix_unique(t.part.select("p_partkey", F.col("p_name").alias("v")), "v", "p_partkey")


@query(
    "R9_unique_after_cut",
    "SELECT count(*) AS n, count(*) AS n_distinct, true AS fits FROM part",
)
def unique_after_cut(t: Tables) -> DataFrame:
    """Values cut to ten characters meet again after the suffix; every one still ends up unique."""
    cut = t.part.select("p_partkey", F.left("p_name", F.lit(10)).alias("v"))
    fixed = r.fix_unique(cut, "v", "p_partkey", max_length=10)
    return fixed.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("n_distinct"),
        F.bool_and(F.char_length("v") <= 10).alias("fits"),
    )


@query(
    "R9_fix_unique_integer",
    """WITH x AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn FROM part)
       SELECT p_partkey, v AS v_old, CASE WHEN rn = 1 THEN v ELSE (SELECT max(v) FROM x)
              + row_number() OVER (PARTITION BY rn = 1 ORDER BY v, p_partkey) END AS v FROM x""",
)
def unique_integer(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_size").cast("bigint").alias("v"))
    return r.fix_unique(rows, "v", "p_partkey", "integer")


@query(
    "R9_fix_unique_uuid",
    """WITH x AS (SELECT p_partkey, p_name AS v, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part),
       h AS (SELECT *, md5(v || '|' || rn) AS m FROM x)
       SELECT p_partkey, v AS v_old, CASE WHEN rn = 1 THEN v ELSE substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-'
              || substr(m, 17, 4) || '-' || substr(m, 21, 12) END AS v FROM h""",
)
def unique_uuid(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("v"))
    return r.fix_unique(rows, "v", "p_partkey", "uuid")


@query(
    "R10_cascade_all_to_first",
    """WITH p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part),
       m AS (SELECT p_name AS old, p_name || '_1000' AS new FROM p WHERE rn = 2)
       SELECT l_orderkey, l_linenumber, coalesce(new, p_name) AS name
       FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN m ON old = p_name""",
)
def cascade(t: Tables) -> DataFrame:
    fixed = r.fix_unique(t.part.select("p_partkey", F.col("p_name").alias("name")), "name", "p_partkey")
    changed = fixed.filter(F.col("name") != F.col("name_old")).select(
        F.col("name_old").alias("old_value"), F.col("name").alias("new_value"), F.col("p_partkey").alias("nth")
    )
    names = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    children = lookup_join(lines, names, ["l_partkey"], counted=True).drop("l_partkey")
    return r.cascade_update(children, "name", changed, "all_to_first")


# --- coercion -------------------------------------------------------------------------


_ENUM = """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'not-started' WHEN 1 THEN 'IN PROGRESS' WHEN 2 THEN 'done' WHEN 3 THEN ' Done '
           ELSE o_orderpriority END AS status FROM {orders}
    """
_ALLOWED = ["not_started", "in_progress", "Done"]


@query(
    "R11a_match_enum",
    f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'not_started' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'Done' WHEN 3 THEN 'Done'
        ELSE ['not_started', 'in_progress', 'Done'][CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 3 + 1] END AS status
        FROM ({plain(_ENUM)}) x""",
)
def enum_match(t: Tables) -> DataFrame:
    allowed = F.array(*[F.lit(a) for a in _ALLOWED])
    return t.sql(_ENUM).select("o_orderkey", r.match_enum("status", allowed, "o_orderkey").alias("status"))


@query(
    "R11b_clamp_integer",
    """SELECT o_orderkey, CAST(greatest(least(x, 127), -128) AS BIGINT) AS tiny, CAST(greatest(least(x, 32767), -32768) AS BIGINT) AS small,
              CAST(greatest(least(x, 9999), -9999) AS BIGINT) AS number4
       FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) - 200000 AS x FROM orders)""",
)
def clamp(t: Tables) -> DataFrame:
    x = F.col("o_totalprice").cast("bigint") - 200000
    types = {"tiny": "TINYINT", "small": "SMALLINT", "number4": "NUMBER(4)"}
    return t.orders.select(
        "o_orderkey", *[r.clamp_integer(x, declared).cast("bigint").alias(name) for name, declared in types.items()]
    )


@query(
    "R11c_parse_boolean",
    """SELECT c_custkey, CASE WHEN w IS NULL THEN NULL ELSE lower(w) IN ('true', '1', 'yes') END AS v FROM
       (SELECT c_custkey, ['true', 'YES', '0', 'no', '1', 'on', NULL][c_custkey % 7 + 1] AS w FROM customer)""",
)
def booleans(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ["true", "YES", "0", "no", "1", "on", None]])
    return t.customer.select("c_custkey", r.parse_boolean(F.get(words, (F.col("c_custkey") % 7).cast("int"))).alias("v"))


_TIMES = """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN '08:00:00.25' WHEN 1 THEN '2024-03-15' WHEN 2 THEN '2024-03-15 10:00:00' ELSE props END
      AS s FROM {events}
    """


@query(
    "R11d_complete_date",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-01-01 08:00:00' WHEN 1 THEN s || ' 00:00:00' ELSE s END AS ts,
        CASE event_id % 4 WHEN 0 THEN '2024-01-01 08:00:00' ELSE s END AS d, s AS t FROM ({plain(_TIMES)}) x""",
)
def dates(t: Tables) -> DataFrame:
    return t.sql(_TIMES).select(
        "event_id",
        r.complete_date("s", "TIMESTAMP").alias("ts"),
        r.complete_date("s", "DATE").alias("d"),
        r.complete_date("s", "TIME").alias("t"),
    )


@query("R11e_cut_text", "SELECT doc_id, left(text, 40) AS v FROM documents")
def cut_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", r.cut_text("text", 40).alias("v"))


_RAW = """
    SELECT o_orderkey, lower(o_orderstatus) AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_custkey * 1000 AS STRING) END AS qty,
           CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag, '2024-03-15' AS due, o_orderpriority AS note FROM {orders}
    """
_SPEC = {
    "status": {"data_type": "CHAR(1)", "allowed": ["O", "F", "P"]},
    "qty": {"data_type": "SMALLINT"},
    "flag": {"data_type": "BOOLEAN"},
    "due": {"data_type": "DATETIME"},
    "note": {"data_type": "VARCHAR(4)", "max_length": 4},
}


@query(
    "R11_coerce_columns",
    f"""SELECT o_orderkey, upper(status) AS status, CASE WHEN qty = 'n/a' THEN qty ELSE CAST(least(CAST(qty AS BIGINT), 32767) AS VARCHAR) END AS qty,
        CASE flag WHEN 'yes' THEN 'true' ELSE 'false' END AS flag, due || ' 00:00:00' AS due, left(note, 4) AS note FROM ({plain(_RAW)}) x""",
)
def coerce(t: Tables) -> DataFrame:
    return r.coerce_columns(t.sql(_RAW), _SPEC, "o_orderkey")


_GAPS = """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN ' ' ELSE c_mktsegment END AS seg,
           CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS qty, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2020-05-05' END AS due
    FROM {customer}
    """


@query(
    "R12_fill_required",
    f"""SELECT c_custkey, CASE WHEN trim(coalesce(seg, '')) = '' THEN 'BUILDING' ELSE seg END AS seg, coalesce(CAST(qty AS VARCHAR), '0') AS qty,
        CASE WHEN due = '' THEN '2024-01-01 00:00:00' ELSE due END AS due FROM ({plain(_GAPS)}) x""",
)
def fill_required(t: Tables) -> DataFrame:
    spec = {
        "seg": {"data_type": "VARCHAR(20)", "allowed": ["BUILDING", "AUTOMOBILE"]},
        "qty": {"data_type": "INT"},
        "due": {"data_type": "TIMESTAMP"},
    }
    return r.fill_required(t.sql(_GAPS), spec)


_NO_IDS = "SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS id, c_name FROM {customer}"


@query(
    "R12_fill_missing_ids",
    f"""WITH x AS ({plain(_NO_IDS)}) SELECT id, c_name FROM x WHERE id IS NOT NULL
        UNION ALL SELECT (SELECT max(id) FROM x) + row_number() OVER (ORDER BY c_name), c_name FROM x WHERE id IS NULL""",
)
def missing_ids(t: Tables) -> DataFrame:
    return r.fill_missing_ids(t.sql(_NO_IDS), "id", ["c_name"])


def _h(column: str) -> str:
    return f"CAST('0x' || substr(md5(c_custkey || ':{column}:5'), 1, 8) AS BIGINT)"


@query(
    "R13_generate_rows",
    f"""SELECT c_custkey + 501 AS id, CASE WHEN c_custkey >= 2 THEN 501 + {_h('boss')} % c_custkey END AS boss, 1 + {_h('dept')} % 25 AS dept,
        ['new', 'open', 'closed'][c_custkey % 3 + 1] AS state, 1 + {_h('qty')} % 1000 AS qty, (1 + {_h('price')} % 999999) / 100.0 AS price,
        {_h('flag')} % 2 = 1 AS flag,
        (2020 + {_h('born.y')} % 6) || '-' || lpad(CAST(1 + {_h('born.m')} % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + {_h('born.d')} % 28 AS VARCHAR), 2, '0')
          AS born, 'label_' || (c_custkey + 1) AS label, '{{"key": "value_' || c_custkey || '"}}' AS doc FROM customer""",
)
def generate(t: Tables) -> DataFrame:
    spec = {
        "id": {"data_type": "INT", "pk": True},
        "boss": {"data_type": "INT", "self_fk": True},
        "dept": {"data_type": "INT", "parent_count": 25},
        "state": {"data_type": "VARCHAR(10)", "allowed": ["new", "open", "closed"]},
        "qty": {"data_type": "INT"},
        "price": {"data_type": "DECIMAL(8,2)"},
        "flag": {"data_type": "BOOLEAN"},
        "born": {"data_type": "DATE"},
        "label": {"data_type": "VARCHAR(20)"},
        "doc": {"data_type": "JSON"},
    }
    return r.generate_rows(t.customer.select("c_custkey"), "c_custkey", spec, 501, 5)


@query(
    "R13_generate_rows_from_parent",
    """WITH k AS (SELECT s_suppkey * 7 + 3 AS key, row_number() OVER (ORDER BY s_suppkey * 7 + 3) AS place FROM supplier WHERE s_suppkey % 3 > 0),
       c AS (SELECT c_custkey, CAST('0x' || substr(md5(c_custkey || ':supplier:5'), 1, 15) AS BIGINT) % (SELECT count(*) FROM k) + 1 AS place FROM customer)
       SELECT c_custkey + 1 AS id, key AS supplier, CAST(NULL AS BIGINT) AS nobody FROM c JOIN k USING (place)""",
)
def generate_from_parent(t: Tables) -> DataFrame:
    parent = t.supplier.filter(F.col("s_suppkey") % 3 > 0).select((F.col("s_suppkey") * 7 + 3).alias("key"))
    spec = {
        "id": {"data_type": "INT", "pk": True},
        "supplier": {"data_type": "BIGINT", "parent": (parent, "key")},
        "nobody": {"data_type": "BIGINT", "parent": (parent.limit(0), "key")},
    }
    return r.generate_rows(t.customer.select("c_custkey"), "c_custkey", spec, 1, 5)


_POOL = """
    SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 40 = 0 THEN '' ELSE upper(p_type) END
      AS label FROM {part}
    """


@query(
    "R14_merge_entity_pools",
    f"""WITH x AS ({plain(_POOL)}), k AS (
        SELECT *, row_number() OVER (PARTITION BY name IS NULL, CASE WHEN name IS NULL THEN p_partkey END, lower(trim(name)) || '|' || lower(trim(label))
               ORDER BY p_partkey) AS rn FROM x)
        SELECT p_partkey, name, label FROM k WHERE rn = 1 ORDER BY p_partkey LIMIT 100""",
)
def merge_pools(t: Tables) -> DataFrame:
    return r.merge_entity_pools(t.sql(_POOL), ["name", "label"], [F.col("p_partkey")], 100)


# --- nested and damaged input ------------------------------------------------------------


def _operations(t: Tables) -> DataFrame:
    """One JSON array of operations per order: its status row and a note that is no table."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    operation = F.struct(
        F.col("o_orderpriority").alias("_scenario"),
        F.array(row, row).alias("Orders"),
        F.array(F.struct(F.col("o_custkey").alias("id"))).alias("customers"),
        F.array(F.struct(F.lit(1).alias("x"))).alias("strangers"),
        F.lit("text").alias("notes"),
    )
    return t.orders.select("o_orderkey", F.to_json(F.array(operation)).alias("doc"))


@query(
    "R15_ingest_operations",
    """SELECT o_orderkey, CAST(0 AS INTEGER) AS op_index, 'orders' AS table_name, CAST(i AS INTEGER) AS row_index,
              CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS state FROM orders CROSS JOIN generate_series(0, 1) AS g(i)
       UNION ALL SELECT o_orderkey, CAST(0 AS INTEGER), 'customers', CAST(0 AS INTEGER), CAST(o_custkey AS VARCHAR), NULL FROM orders""",
)
def ingest(t: Tables) -> DataFrame:
    rows = r.ingest_operations(_operations(t), "doc", ["orders", "customers"], ["o_orderkey"])
    return rows.select(
        "o_orderkey", "op_index", "table_name", "row_index", F.col("row")["id"].alias("id"), F.col("row")["state"].alias("state")
    )


_DAMAGED = """
    SELECT event_id, CASE event_id % 6
      WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```'
      WHEN 1 THEN '<think>maybe</think> ' || props
      WHEN 2 THEN replace(props, '}', ',}')
      WHEN 3 THEN replace(props, ': ', ': 00')
      WHEN 4 THEN replace(props, '}', '')
      ELSE props END AS doc FROM {events}
    """.replace("'}'", "'}}'").replace("',}'", "',}}'")
_DAMAGED_PLAIN = plain(_DAMAGED).replace("}}", "}")


@query(
    "R16_parse_json",
    f"""SELECT event_id, CASE WHEN event_id % 6 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
        CASE WHEN event_id % 6 = 4 THEN 'not json' END AS reason FROM events JOIN (SELECT event_id AS e FROM ({_DAMAGED_PLAIN}) x) ON e = event_id""",
)
def parse_json(t: Tables) -> DataFrame:
    parsed, rejected = r.parse_json_column(t.sql(_DAMAGED), "doc", "k BIGINT")
    none = F.lit(None)
    return parsed.select("event_id", F.col("parsed.k").alias("k"), none.cast("string").alias("reason")).unionByName(
        rejected.select("event_id", none.cast("bigint").alias("k"), "reason")
    )



# Strings that hold what is repaired between strings; every fifth text has a string without an end.
@query(
    "R16_strings_kept",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey END AS k, CASE WHEN p_partkey % 5 > 0 THEN p_name || ' 007, ] ' || chr(92) || 'q ``` </think>' END AS s,
              CASE WHEN p_partkey % 5 > 0 THEN CAST(-p_size AS BIGINT) END AS n, CASE WHEN p_partkey % 5 = 0 THEN 'a string without an end' END AS detail FROM part""",
)
def strings_kept(t: Tables) -> DataFrame:
    quote, slash = F.lit('"'), F.lit("\\")
    doc = F.concat(
        F.lit('Sure: [{"k": 000'), F.col("p_partkey").cast("string"), F.lit(', "s": "'), "p_name", F.lit(" 007, ] "), slash, F.lit("q ``` </think>"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(quote), F.lit(', "n": -0'), F.col("p_size").cast("string"), F.lit(",},\n] - done"),
    )
    parsed, rejected = r.parse_json_column(t.part.select("p_partkey", doc.alias("doc")), "doc", "array<struct<k:bigint,s:string,n:bigint>>")
    rows = parsed.select("p_partkey", F.inline("parsed"))
    return rows.unionByName(rejected.select("p_partkey", "detail"), allowMissingColumns=True)


@query(
    "R11_decimal_digits",
    """SELECT p_partkey, k || '12345678901234.25' AS price, k || '.5' AS rate, CASE WHEN k < 10 THEN k || '.0' ELSE k || '' END AS small,
              k || '000.0' AS power FROM (SELECT p_partkey, p_partkey + 1 AS k FROM part)""",
)
def decimal_digits(t: Tables) -> DataFrame:
    key = (F.col("p_partkey") + 1).cast("string")
    raw = t.part.select(
        "p_partkey",
        F.concat(key, F.lit("12345678901234.250")).alias("price"),
        F.concat(key, F.lit(".4999")).alias("rate"),
        key.alias("small"),
        F.concat(key, F.lit("e3")).alias("power"),
    )
    kinds = {"price": "DECIMAL(30,2)", "rate": "NUMERIC(12,2)", "small": "NUMBER(2,1)", "power": "DECIMAL(20,4)"}
    return r.coerce_columns(raw, {c: {"data_type": k} for c, k in kinds.items()}, "p_partkey")
