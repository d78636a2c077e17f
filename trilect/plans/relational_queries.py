"""One query per relational operator: filters, joins, aggregates, windows, order, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilect.functions import dialect as d
from trilect.operators.ordering import lookup_join
from trilect.operators.relational import (
    densify,
    distinct_list,
    distinct_on,
    full_key_diff,
    hierarchy,
    lag_in_order,
    lookup_with_missing,
    ordered_list,
    paginate,
    rank_top,
    rollup_labelled,
    row_numbers,
    rownum_before_order,
    top_per_key,
)
from trilect.plans.corpus import ORDERS_AS_OF, day, moment, money
from trilect.plans.registry import Tables, plain, query
from trilect.session import cut

# --- projection, filter, predicate ---------------------------------------------------


@query(
    "F1_date_range_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'",
)
def date_range(t: Tables) -> DataFrame:
    inside = (F.col("o_orderdate") >= moment("1997-01-01")) & (F.col("o_orderdate") < moment("1998-01-01"))
    return t.orders.filter(inside).select("o_orderkey", "o_totalprice")


@query("F2_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring'")
def like(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").like("%ring")).select("p_partkey", "p_name")


@query("F3_ilike", "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'BRAND#1%'")
def ilike(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_brand").ilike("BRAND#1%")).select("p_partkey", "p_brand")


@query(
    "F4_regex_predicate",
    r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue)\s+[a-z]+$')",
)
def regex_predicate(t: Tables) -> DataFrame:
    pattern = d.regex("^(red|blue)[[:space:]]+[a-z]+$")
    return t.part.filter(F.col("p_name").rlike(pattern)).select("p_partkey", "p_name")


@query(
    "F5_null_safe_equality",
    """SELECT c_custkey, nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_custkey % 25, 3) AS same
       FROM customer""",
)
def null_safe_equality(t: Tables) -> DataFrame:
    a, b = F.nullif(F.col("c_nationkey").cast("bigint"), F.lit(3)), F.nullif(F.col("c_custkey") % 25, F.lit(3))
    return t.customer.select("c_custkey", a.eqNullSafe(b).alias("same"))


@query(
    "F6_membership",
    """SELECT o_orderkey, o_orderstatus IN ('O', 'P') AS in_list, o_orderpriority IN ('1-URGENT', '2-HIGH') AS in_array,
              o_orderstatus IN ('F', 'P') AS in_csv FROM orders""",
)
def membership(t: Tables) -> DataFrame:
    urgent = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderstatus").isin("O", "P").alias("in_list"),
        F.array_contains(urgent, F.col("o_orderpriority")).alias("in_array"),
        d.in_csv("o_orderstatus", "F,P").alias("in_csv"),
    )


@query(
    "F7_null_tests",
    """SELECT count(*) FILTER (WHERE x IS NULL) AS absent, count(*) FILTER (WHERE x IS NOT NULL) AS present
       FROM (SELECT nullif(c_nationkey, 3) AS x FROM customer)""",
)
def null_tests(t: Tables) -> DataFrame:
    x = F.nullif(F.col("c_nationkey"), F.lit(3))
    return t.customer.agg(F.count_if(x.isNull()).alias("absent"), F.count_if(x.isNotNull()).alias("present"))


@query("F8_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def between(t: Tables) -> DataFrame:
    return t.lineitem.filter(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "F9_computed_projection",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)
       AS revenue FROM lineitem""",
)
def computed_projection(t: Tables) -> DataFrame:
    revenue = money("l_extendedprice") * (F.lit(1) - money("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", revenue.cast("double").alias("revenue"))


@query(
    "F10_case_if_decode",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'high' ELSE 'low' END AS band,
              CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE 'other' END AS status,
              CASE WHEN o_totalprice > 100000 THEN 'senior' ELSE 'junior' END AS team FROM orders""",
)
def case_if_decode(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 250000, "high").otherwise("low").alias("band"),
        F.expr("decode(o_orderstatus, 'O', 'open', 'F', 'final', 'other')").alias("status"),
        F.expr("decode(sign(o_totalprice - 100000), 1, 'senior', 'junior')").alias("team"),
    )


# --- joins -----------------------------------------------------------------------------


@query(
    "J1_inner_join_four_way",
    """SELECT r_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def four_way_join(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("s")
    )
    joined = (
        per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name").agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"))


_LEFT = """SELECT c_custkey, count(o_orderkey) AS n_orders, CAST(max(o_orderdate) AS DATE) AS last_order
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey"""


def _left_join(t: Tables) -> DataFrame:
    per_customer = (
        t.orders.filter(F.col("o_orderstatus") == "P")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").cast("date").alias("last_order"))
    )
    return t.customer.select("c_custkey").join(per_customer, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order"
    )


@query("J2_left_join", _LEFT)
def left_join(t: Tables) -> DataFrame:
    return _left_join(t)


@query("J7_plus_sign_outer_join", _LEFT)
def plus_sign_join(t: Tables) -> DataFrame:
    """``WHERE c.c_custkey = o.o_custkey (+)`` is the left join under another spelling."""
    return _left_join(t)


@query(
    "J3_semi_join",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS
       (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def semi_join(t: Tables) -> DataFrame:
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(urgent.distinct(), "c_custkey", "left_semi")


_ORPHAN_LINES = """
    SELECT l_orderkey, l_linenumber, l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS l_partkey
    FROM {lineitem}
    """


@query("J4_anti_join", f"SELECT * FROM ({plain(_ORPHAN_LINES)}) x WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def anti_join(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"))
    return lookup_join(t.sql(_ORPHAN_LINES), parts, ["l_partkey"], "left_anti", counted=True)


@query(
    "J5_self_join",
    """SELECT e.c_custkey, e.c_name AS name, m.c_name AS manager FROM customer e JOIN customer m
       ON m.c_custkey = CAST(floor(e.c_custkey / 10) AS BIGINT) AND e.c_custkey > 0""",
)
def self_join(t: Tables) -> DataFrame:
    staff = t.customer.filter(F.col("c_custkey") > 0).select(
        "c_custkey", F.col("c_name").alias("name"), F.floor(F.col("c_custkey") / 10).alias("boss")
    )
    bosses = t.customer.select(F.col("c_custkey").alias("boss"), F.col("c_name").alias("manager"))
    return lookup_join(staff, bosses, ["boss"], counted=True).drop("boss")


@query(
    "J6_correlated_average",
    """SELECT c_custkey, CAST(CAST(avg_bal AS DECIMAL(18,4)) AS DOUBLE) AS nation_avg, c_acctbal > avg_bal AS above
       FROM customer JOIN (SELECT c_nationkey AS k, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_bal
       FROM customer GROUP BY 1) a ON k = c_nationkey""",
)
def correlated_average(t: Tables) -> DataFrame:
    mean = t.customer.groupBy("c_nationkey").agg(
        (F.sum(money("c_acctbal")).cast("double") / F.count(F.lit(1))).alias("avg_bal")
    )
    rows = lookup_join(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), mean, ["c_nationkey"])
    return rows.select(
        "c_custkey",
        F.col("avg_bal").cast("decimal(18,4)").cast("double").alias("nation_avg"),
        (F.col("c_acctbal") > F.col("avg_bal")).alias("above"),
    )


@query(
    "J8_full_outer_key_diff",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side
       FROM (SELECT DISTINCT o_custkey AS k FROM orders) a
       FULL JOIN (SELECT c_custkey * 2 AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
)
def full_outer(t: Tables) -> DataFrame:
    left = t.orders.select(F.col("o_custkey").alias("k"))
    right = t.customer.select((F.col("c_custkey") * 2).alias("k"))
    return full_key_diff(left, right, ["k"])


@query(
    "J9_lookup_with_missing",
    """SELECT l_orderkey, l_linenumber, p_brand, p_partkey IS NULL AS missing
       FROM (SELECT l_orderkey, l_linenumber, l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS k FROM lineitem)
       LEFT JOIN part ON p_partkey = k""",
)
def missing_report(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lookup_with_missing(t.sql(_ORPHAN_LINES), parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", "p_brand", "missing"
    )


# --- aggregation ---------------------------------------------------------------------------


@query(
    "A1_grouped_aggregates",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
              CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS avg_qty,
              min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2""",
)
def grouped(t: Tables) -> DataFrame:
    qty = F.sum(money("l_quantity")).cast("double")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        qty.alias("qty"),
        (qty / F.count("l_quantity")).alias("avg_qty"),
        F.min("l_extendedprice").alias("lo"),
        F.max("l_extendedprice").alias("hi"),
    )


@query(
    "A2_null_substituted_average",
    """SELECT c_mktsegment, CAST(sum(coalesce(CASE WHEN c_nationkey = 3 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) END, 0)) AS DOUBLE)
       / count(*) AS avg_bal FROM customer GROUP BY 1""",
)
def substituted_average(t: Tables) -> DataFrame:
    balance = F.when(F.col("c_nationkey") != 3, money("c_acctbal"))
    filled = d.null_substitute(balance, F.lit(0).cast("decimal(18,2)"))
    return t.customer.groupBy("c_mktsegment").agg(
        (F.sum(filled).cast("double") / F.count(F.lit(1))).alias("avg_bal")
    )


@query("A3_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 12)


@query(
    "A4_conditional_aggregate",
    """SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_if,
              count(*) FILTER (WHERE o_orderstatus = 'F') AS final_filter FROM orders GROUP BY 1""",
)
def conditional(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("open_if"),
        F.count_if(F.col("o_orderstatus") == "F").alias("final_filter"),
    )


@query(
    "A5_filtered_distinct_count",
    """SELECT event_type, count(DISTINCT user_id) FILTER (WHERE value > 4) AS users FROM events GROUP BY 1""",
)
def filtered_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count_distinct(F.when(F.col("value") > 4, F.col("user_id"))).alias("users")
    )


@query(
    "A6_ordered_string_list",
    """SELECT c_mktsegment, string_agg(n_name || '=' || n, ', ' ORDER BY n DESC, n_name) AS nations FROM
       (SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1""",
)
def string_list(t: Tables) -> DataFrame:
    counted = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat("n_name", F.lit("="), F.col("n").cast("string"))
    return named.groupBy("c_mktsegment").agg(
        ordered_list(text, F.struct((-F.col("n")).alias("n"), F.col("n_name"))).alias("nations")
    )


@query(
    "A7_distinct_array",
    "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY 1",
)
def distinct_array(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(distinct_list("p_type").alias("types"))


@query("A8_bool_and", "SELECT l_suppkey, bool_and(l_quantity > 1) AS every FROM lineitem GROUP BY 1")
def bool_and(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.bool_and(F.col("l_quantity") > 1).alias("every"))


@query(
    "A9_rollup_labelled",
    """SELECT coalesce(c_mktsegment, '[Total]') AS segment, coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), '[Subtotal]') AS nation,
              count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, nullif(c_nationkey, 3))""",
)
def rollup(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_mktsegment").alias("segment"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation")
    )
    leaves = rows.groupBy("segment", "nation").agg(F.count(F.lit(1)).alias("n"))
    labels = {"segment": "[Total]", "nation": "[Subtotal]"}
    return rollup_labelled(leaves, ["segment", "nation"], [F.sum("n").alias("n")], labels)


@query(
    "A9_rollup_marked_totals",
    """SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN '[Total]' ELSE c_mktsegment END AS segment,
              CASE WHEN grouping(k) = 1 THEN '[Subtotal]' ELSE k END AS nation, count(*) AS n
       FROM (SELECT c_mktsegment, CAST(nullif(c_nationkey, 3) AS VARCHAR) AS k FROM customer) GROUP BY ROLLUP (c_mktsegment, k)""",
)
def rollup_marked(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_mktsegment").alias("segment"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation")
    )
    leaves = rows.groupBy("segment", "nation").agg(F.count(F.lit(1)).alias("n"))
    labels = {"segment": "[Total]", "nation": "[Subtotal]"}
    return rollup_labelled(leaves, ["segment", "nation"], [F.sum("n").alias("n")], labels, mark_totals_only=True)


@query(
    "A10_group_by_date_bucket",
    "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1",
)
def date_bucket(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(d.date_format("l_shipdate", "%Y-%m", "mysql").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "A11_two_level_aggregate",
    """SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n""",
)
def two_level(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


# --- windows -----------------------------------------------------------------------------------


@query(
    "W1_lag_gap",
    """SELECT o_orderkey, CAST(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
       CAST(o_orderdate AS DATE)) AS INTEGER) AS gap_days FROM orders""",
)
def lag_gap(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    lagged = lag_in_order(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "_before")
    return lagged.select("o_orderkey", d.days_between("o_orderdate", "_before").alias("gap_days"))


@query(
    "W2_rank_top_n",
    """SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS INTEGER) AS rank
       FROM part) WHERE rank <= 3""",
)
def top_by_rank(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice")
    return rank_top(rows, ["p_brand"], [F.col("p_retailprice").desc()], 3)


@query(
    "W3_row_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, row_number() OVER
       (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem""",
)
def row_number(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag"
    )
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return row_numbers(rows, ["l_returnflag"], order, "rn").drop("l_returnflag")


@query(
    "W4_distinct_on",
    """SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders
       ORDER BY o_custkey, o_totalprice DESC, o_orderkey""",
)
def first_per_key(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return distinct_on(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query(
    "W5_window_over_formatted_date",
    """SELECT * FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
       CAST(rank() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC) AS INTEGER) AS month_rank FROM orders)
       WHERE month_rank <= 5""",
)
def formatted_window(t: Tables) -> DataFrame:
    month = d.date_format("o_orderdate", "%Y-%m", "mysql")
    rows = t.orders.select("o_orderkey", "o_totalprice", month.alias("month"))
    return rank_top(rows, ["month"], [F.col("o_totalprice").desc()], 5, "month_rank").drop("o_totalprice")


# --- order, limit, pages ----------------------------------------------------------------------


@query("L1_order_by", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey")
def order_by(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_size").orderBy(F.col("p_size").desc(), "p_name", "p_partkey")


for _dialect, _nulls in (("mysql", "FIRST"), ("pg", "LAST"), ("oracle", "LAST")):

    @query(
        f"L2_null_order_{_dialect}",
        f"""SELECT c_custkey, k, row_number() OVER (ORDER BY k ASC NULLS {_nulls}, c_custkey) AS place
            FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)""",
    )
    def null_order(t: Tables, dialect: str = _dialect) -> DataFrame:
        rows = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))
        return row_numbers(rows, [], [d.order_by("k", dialect), "c_custkey"], "place")


@query("L3_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 50")
def page(t: Tables) -> DataFrame:
    return paginate(t.customer.select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 50, 10)


@query("L4_rownum_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rownum_top(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query(
    "L5_rownum_before_order",
    """SELECT least(count(*), 100) AS n, least(count(*), 100) AS known, CAST(0 AS BIGINT) AS out_of_order FROM orders""",
)
def rownum_then_order(t: Tables) -> DataFrame:
    """Which rows come is open; how many, that they are rows of the table and their order are not."""
    rows = t.orders.select("o_orderkey", "o_totalprice")
    taken = cut(rownum_before_order(rows, 100, [F.col("o_totalprice").desc()]).withColumn("at", F.monotonically_increasing_id()))
    before = F.lag("o_totalprice").over(Window.orderBy("at"))
    ordered = taken.withColumn("out", F.coalesce(before < F.col("o_totalprice"), F.lit(False)))
    known = ordered.join(rows.withColumn("known", F.lit(True)).distinct(), ["o_orderkey", "o_totalprice"], "left")
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("known"), F.count_if("out").alias("out_of_order"))


# --- sets, recursion, series ----------------------------------------------------------------------


@query(
    "S1_union",
    """SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1, 2
       UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 1, 2""",
)
def union(t: Tables) -> DataFrame:
    def counted(df: DataFrame, kind: str, nation: str) -> DataFrame:
        return df.groupBy(F.lit(kind).alias("kind"), F.col(nation).alias("nation")).agg(F.count(F.lit(1)).alias("n"))

    return counted(t.customer, "customer", "c_nationkey").unionByName(counted(t.supplier, "supplier", "s_nationkey"))


@query("S1_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events")
def union_distinct(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.events.select("user_id")).distinct()


@query("S2_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def intersect(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.events.select("user_id"))


@query("S3_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_(t: Tables) -> DataFrame:
    pending = t.orders.filter(F.col("o_orderstatus") == "P").select("o_custkey")
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(pending)


_TREE = """SELECT c_custkey, CASE WHEN c_custkey = 0 THEN NULL ELSE CAST(floor(c_custkey / 10) AS BIGINT) END AS manager FROM {customer}"""


@query(
    "S4_hierarchy",
    f"""WITH RECURSIVE e AS ({plain(_TREE)}), o AS (
        SELECT c_custkey, manager, 0 AS depth FROM e WHERE manager IS NULL
        UNION ALL SELECT e.c_custkey, e.manager, o.depth + 1 FROM e JOIN o ON e.manager = o.c_custkey)
        SELECT c_custkey, manager, CAST(depth AS INTEGER) AS depth FROM o""",
)
def org_tree(t: Tables) -> DataFrame:
    return hierarchy(t.sql(_TREE), "c_custkey", "manager")


@query(
    "S5_densify",
    """SELECT CAST(d AS DATE) AS day, coalesce(n, 0) AS n FROM
       generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) AS g(d)
       LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS k, count(*) AS n FROM orders GROUP BY 1) ON k = CAST(d AS DATE)""",
)
def densified(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return densify(counts, "day", day("1995-01-01"), day("2001-12-31"), "1 DAY", {"n": 0})


@query(
    "S6_cte_chain",
    f"""WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1),
        b AS (SELECT *, date_diff('day', CAST(last AS DATE), DATE '{ORDERS_AS_OF}') AS idle FROM a),
        c AS (SELECT n, min(idle) AS lo, max(idle) AS hi FROM b GROUP BY n)
        SELECT n, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM c""",
)
def chained(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    b = a.withColumn("idle", d.days_between(day(ORDERS_AS_OF), "last"))
    return b.groupBy("n").agg(F.min("idle").alias("lo"), F.max("idle").alias("hi"))


@query(
    "W3_top_rows_per_key",
    """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2""",
)
def newest_two(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return top_per_key(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 2).drop("o_orderdate")


@query(
    "W3_thousands_per_key",
    """SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 1500""",
)
def first_thousands(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_per_key(rows, ["l_returnflag"], ["l_extendedprice DESC", "l_orderkey", "l_linenumber"], 1500).drop("l_extendedprice")


@query(
    "L3_deep_page",
    "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40 OFFSET 30000",
)
def deep(t: Tables) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return paginate(t.lineitem, order, 30_000, 40).select("l_orderkey", "l_linenumber")


# Customers in one chain by key, but for every 500th, which points back into its own part of it.
_CHAIN = """
    SELECT c_custkey, CASE WHEN c_custkey = first THEN NULL WHEN c_custkey % 500 = 499 AND c_custkey > first + 900 THEN c_custkey + 0
                      ELSE c_custkey - 1 END AS above
    FROM {customer} CROSS JOIN (SELECT min(c_custkey) AS first FROM {customer})
    """


@query(
    "S4_chain",
    f"""WITH RECURSIVE e AS ({plain(_CHAIN)}), o AS (
        SELECT c_custkey, 1 AS level FROM e WHERE above IS NULL UNION ALL SELECT e.c_custkey, o.level + 1 FROM e JOIN o ON e.above = o.c_custkey)
        SELECT c_custkey, CAST(level AS INTEGER) AS level FROM o""",
)
def chain(t: Tables) -> DataFrame:
    return hierarchy(t.sql(_CHAIN), "c_custkey", "above", root_level=1, name="level").drop("above")
