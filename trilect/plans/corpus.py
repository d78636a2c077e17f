"""The query corpus: fifteen shapes, each in the three dialects.

Employees are customers, departments are nations, time sheets are orders or
events. Sums run over DECIMAL so that results do not depend on row order. Fact
rows are aggregated by their join key before they are joined, which removes hot
keys and most of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilect.functions import dialect as d
from trilect.operators.ordering import checked_broadcast, lookup_join
from trilect.operators.relational import (
    densify,
    distinct_list,
    distinct_on,
    hierarchy,
    lag_in_order,
    ordered_list,
    paginate,
    rank_top,
    rollup_labelled,
    row_numbers,
)
from trilect.plans.registry import Tables, per_dialect
from trilect.session import cut, spread, store

ORDERS_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31"


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


# --- easy -------------------------------------------------------------------------


@per_dialect(
    "e1_null_safe_avg",
    """
    SELECT count(*) AS cnt, CAST(sum(coalesce(v, 0)) AS DOUBLE) / count(*) AS avg_price
    FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS v
          FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01')
    """,
)
def null_safe_avg(t: Tables, dialect: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 10 != 0, money("o_totalprice"))
    year = t.orders.filter((F.col("o_orderdate") >= moment("1996-01-01")) & (F.col("o_orderdate") < moment("1997-01-01")))
    filled = d.null_substitute(price, F.lit(0).cast("decimal(18,2)"))
    return year.agg(F.count(F.lit(1)).alias("cnt"), F.sum(filled).alias("_s")).select(
        "cnt", (F.col("_s").cast("double") / F.col("cnt")).alias("avg_price")
    )


_E2 = "SELECT c_name || ' ' || c_mktsegment AS full_name, c_mktsegment AS segment FROM customer WHERE "


@per_dialect(
    "e2_concat_like",
    {
        "mysql": _E2 + "c_mktsegment LIKE '%ING'",
        "pg": _E2 + "c_mktsegment ILIKE '%ing'",
        "oracle": _E2 + "c_mktsegment LIKE '%ING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    },
)
def concat_like(t: Tables, dialect: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    wanted = t.customer.filter(segment.ilike("%ing") if dialect == "pg" else segment.like("%ING"))
    if dialect == "oracle":
        wanted = wanted.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(10)
    return wanted.select(
        d.concat("c_name", F.lit(" "), "c_mktsegment", dialect=dialect).alias("full_name"), segment.alias("segment")
    )


@per_dialect(
    "e3_pagination",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10",
)
def pagination(t: Tables, dialect: str) -> DataFrame:
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    if dialect != "oracle":
        return paginate(rows, order, 10, 10)
    # ROW_NUMBER() BETWEEN 11 AND 20: the upper bound turns into a top-20 before the window
    top = rows.orderBy(*order).limit(20)
    numbered = top.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    return numbered.filter(F.col("rn").between(11, 20)).drop("rn")


# --- medium -----------------------------------------------------------------------


@per_dialect(
    "m1_month_bucket_semi_join",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, c_custkey, c_name,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)
    GROUP BY 1, 2, 3
    """,
)
def month_bucket(t: Tables, dialect: str) -> DataFrame:
    fmt = "%Y-%m" if dialect == "mysql" else "YYYY-MM"
    per_customer = t.orders.groupBy(d.date_format("o_orderdate", fmt, dialect).alias("month"), "o_custkey").agg(
        F.sum(money("o_totalprice")).alias("total")
    )
    nations = t.nation.filter(F.col("n_regionkey") == 3).select(F.col("n_nationkey").alias("c_nationkey"))
    people = t.customer.join(nations, "c_nationkey", "left_semi").select("c_custkey", "c_name")
    return per_customer.join(people, per_customer["o_custkey"] == people["c_custkey"]).select(
        "month", "c_custkey", "c_name", F.col("total").cast("double").alias("total")
    )


@per_dialect(
    "m2_conditional_sum_ordered_list",
    """
    SELECT r_name, CAST(sum(CASE WHEN bal >= 300000 THEN 1 ELSE 0 END) AS BIGINT) AS high_count,
           CAST(sum(CASE WHEN bal < 300000 THEN 1 ELSE 0 END) AS BIGINT) AS low_count,
           string_agg(n_name, ', ' ORDER BY n_name) AS all_names
    FROM region JOIN (
      SELECT n_regionkey, n_name, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS bal
      FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) n ON n_regionkey = r_regionkey
    GROUP BY r_name
    """,
)
def conditional_sum(t: Tables, dialect: str) -> DataFrame:
    balance = t.customer.groupBy("c_nationkey").agg(F.sum(money("c_acctbal")).alias("bal"))
    nations = t.nation.join(balance, F.col("n_nationkey") == F.col("c_nationkey"))
    high = F.col("bal") >= 300000
    return (
        nations.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(
            F.sum(F.when(high, 1).otherwise(0)).alias("high_count"),
            F.sum(F.when(~high, 1).otherwise(0)).alias("low_count"),
            ordered_list("n_name", "n_name").alias("all_names"),
        )
    )


@per_dialect(
    "m3_overdue_days",
    f"""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS end_date,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}') AS INTEGER) AS overdue_days
    FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < DATE '{ORDERS_AS_OF}' - INTERVAL 30 DAY
    """,
)
def overdue_days(t: Tables, dialect: str) -> DataFrame:
    spelled = {"mysql": "INTERVAL 30 DAY", "pg": "INTERVAL '30 days'", "oracle": "INTERVAL '30' DAY"}[dialect]
    limit = d.shift_days(day(ORDERS_AS_OF), -d.interval_days(spelled)).cast("timestamp_ntz")
    late = t.orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < limit))
    return late.select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("end_date"),
        d.days_between(day(ORDERS_AS_OF), "o_orderdate").alias("overdue_days"),
    )


_M4_YEAR = """
    SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(month(o_orderdate) AS INTEGER) AS order_month,
           count(*) AS new_orders
    FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    GROUP BY 1, 2, 3 HAVING count(*) >= 2
    """


@per_dialect(
    "m4_year_month_having",
    {
        "mysql": _M4_YEAR,
        "oracle": _M4_YEAR,
        "pg": """
    SELECT n_name, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS returned_qty,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS accepted_qty
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
    """,
    },
)
def year_month_having(t: Tables, dialect: str) -> DataFrame:
    if dialect == "pg":
        flag = F.col("l_returnflag")
        per_supplier = t.lineitem.groupBy("l_suppkey").agg(
            F.sum(F.when(flag == "R", money("l_quantity"))).alias("r"),
            F.sum(F.when(flag == "A", money("l_quantity"))).alias("a"),
        )
        located = per_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
            t.nation, F.col("s_nationkey") == F.col("n_nationkey")
        )
        return located.groupBy("n_name").agg(
            F.sum("r").cast("double").alias("returned_qty"), F.sum("a").cast("double").alias("accepted_qty")
        )
    year, month = d.date_part("YEAR", "o_orderdate"), d.date_part("MONTH", "o_orderdate")
    per_customer = t.orders.groupBy("o_custkey", year.alias("order_year"), month.alias("order_month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    located = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        located.groupBy("n_name", "order_year", "order_month")
        .agg(F.sum("n").alias("new_orders"))
        .filter(F.col("new_orders") >= 2)
    )


# --- hard -------------------------------------------------------------------------

_H1_LAG = f"""
    SELECT event_id, user_id, CAST(ts AS DATE) AS work_date, value,
           CAST(date_diff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)) AS INTEGER)
             AS gap_days
    FROM events WHERE ts >= DATE '{EVENTS_AS_OF}' - INTERVAL 90 DAY
    """


@per_dialect(
    "h1_lag_or_distinct_on",
    {
        "mysql": _H1_LAG,
        "oracle": _H1_LAG,
        "pg": """
    SELECT DISTINCT ON (n_name) n_name, c_name || ' ' || c_mktsegment AS full_name, CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS DOUBLE) AS salary
    FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    ORDER BY n_name, c_acctbal DESC, c_custkey
    """,
    },
)
def lag_or_distinct_on(t: Tables, dialect: str) -> DataFrame:
    if dialect == "pg":
        active = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
        people = t.customer.join(active, "c_custkey", "left_semi").join(
            t.nation, F.col("c_nationkey") == F.col("n_nationkey")
        )
        return distinct_on(people, ["n_name"], [F.col("c_acctbal").desc(), F.col("c_custkey")]).select(
            "n_name",
            d.concat("c_name", F.lit(" "), "c_mktsegment", dialect="pg").alias("full_name"),
            d.to_numeric("c_acctbal", 10, 2).cast("double").alias("salary"),
        )
    start = d.shift_days(day(EVENTS_AS_OF), -90).cast("timestamp_ntz")
    recent = t.events.filter(F.col("ts") >= start).select("event_id", "user_id", "ts", "value")
    lagged = lag_in_order(recent, ["user_id"], ["ts", "event_id"], "ts", "_before")
    return lagged.select(
        "event_id",
        "user_id",
        F.to_date("ts").alias("work_date"),
        "value",
        d.days_between("ts", "_before").alias("gap_days"),
    )


_H2_FORMAT = f"""
    SELECT n_name, strftime(o_orderdate, '%A, %B %d, %Y') AS hire_date_fmt,
           CAST(round(avg(date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}'))) AS BIGINT) AS avg_tenure,
           CASE WHEN avg(date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}')) > 1000 THEN 'senior' ELSE 'junior' END
             AS team_type
    FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    GROUP BY n_name, o_orderdate
    """


@per_dialect(
    "h2_format_or_filter",
    {
        "mysql": _H2_FORMAT,
        "oracle": _H2_FORMAT,
        "pg": f"""
    SELECT n_name,
           count(*) FILTER (WHERE o_orderdate >= DATE '{ORDERS_AS_OF}' - INTERVAL 90 DAY) AS recent_entries,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate >= DATE '{ORDERS_AS_OF}' - INTERVAL 90 DAY) AS DOUBLE)
             AS recent_total,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '{ORDERS_AS_OF}') AS INTEGER) AS max_tenure_days
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name ORDER BY recent_total DESC NULLS LAST
    """,
    },
)
def format_or_filter(t: Tables, dialect: str) -> DataFrame:
    def located(per_customer: DataFrame) -> DataFrame:
        return per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
            t.nation, F.col("c_nationkey") == F.col("n_nationkey")
        )

    if dialect == "pg":
        recent = F.col("o_orderdate") >= d.shift_days(day(ORDERS_AS_OF), -90).cast("timestamp_ntz")
        per_customer = t.orders.groupBy("o_custkey").agg(
            F.count_if(recent).alias("n"),
            F.sum(F.when(recent, money("o_totalprice"))).alias("r"),
            F.sum(money("o_totalprice")).alias("s"),
            F.min("o_orderdate").alias("first"),
        )
        return (
            located(per_customer)
            .groupBy("n_name")
            .agg(
                F.sum("n").alias("recent_entries"),
                F.sum("r").cast("double").alias("recent_total"),
                F.sum("s").cast("double").alias("total"),
                d.days_between(day(ORDERS_AS_OF), F.min("first")).alias("max_tenure_days"),
            )
            .orderBy(F.col("recent_total").desc_nulls_last())
        )
    fmt = "%W, %M %d, %Y" if dialect == "mysql" else "Day, Month DD, YYYY"
    per_customer = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    tenure = d.days_between(day(ORDERS_AS_OF), "o_orderdate")
    grouped = located(per_customer).groupBy("n_name", "o_orderdate").agg(
        (F.sum(tenure * F.col("n")) / F.sum("n")).alias("tenure")
    )
    senior = (
        F.when(F.col("tenure") > 1000, F.lit("senior")).otherwise(F.lit("junior"))
        if dialect == "mysql"
        else F.expr("decode(sign(tenure - 1000), 1, 'senior', 'junior')")
    )
    return grouped.select(
        "n_name",
        d.date_format("o_orderdate", fmt, dialect).alias("hire_date_fmt"),
        d.to_signed("tenure").alias("avg_tenure"),
        senior.alias("team_type"),
    )


_H3_JSON = """
    SELECT event_type, json_extract_string(props, '$.k') AS skill, count(*) AS cnt,
           CASE WHEN count(*) >= 20 THEN 'core' ELSE 'rare' END AS skill_type
    FROM events
    WHERE json_extract_string(props, '$.k') IS NOT NULL AND regexp_matches(json_extract_string(props, '$.k'), '^(1|2|7)')
    GROUP BY 1, 2 HAVING count(*) >= 1
    """


@per_dialect(
    "h3_json_regex_or_age",
    {
        "mysql": _H3_JSON,
        "oracle": _H3_JSON,
        "pg": f"""
    SELECT o_orderkey, n_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS hire_quarter, c_name,
           CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}') AS INTEGER) AS tenure_years,
           json_extract_string('{{"seg": "' || c_mktsegment || '"}}', '$.seg') AS skill
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    """,
    },
)
def json_regex_or_age(t: Tables, dialect: str) -> DataFrame:
    if dialect == "pg":
        people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("o_custkey"),
            "c_name",
            "n_name",
            F.format_string('{"seg": "%s"}', "c_mktsegment").alias("metadata"),
        )
        rows = lookup_join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), people, ["o_custkey"], counted=True)
        return rows.select(
            "o_orderkey",
            "n_name",
            d.date_trunc("quarter", "o_orderdate").alias("hire_quarter"),
            "c_name",
            d.whole_years(day(ORDERS_AS_OF), "o_orderdate").alias("tenure_years"),
            d.json_text("metadata", "$.seg").alias("skill"),
        ).filter(F.col("skill").isNotNull())
    skill = d.json_text("props", "$.k") if dialect == "mysql" else d.json_text_by_regex("props", "k")
    named = t.events.select("event_type", skill.alias("skill")).filter(
        F.col("skill").isNotNull() & F.col("skill").rlike("^(1|2|7)")
    )
    counted = named.groupBy("event_type", "skill").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= 1)
    kind = (
        F.when(F.col("cnt") >= 20, F.lit("core")).otherwise(F.lit("rare"))
        if dialect == "mysql"
        else F.expr("decode(sign(cnt - 20), -1, 'rare', 'core')")
    )
    return counted.withColumn("skill_type", kind)


_H4 = """
    SELECT coalesce(n_name, '[Total]') AS dept_name, coalesce(p_brand, '[Subtotal]') AS brand, count(*) AS assignment_count,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_qty{extra}
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (n_name, p_brand)
    """


@per_dialect(
    "h4_rollup_labelled",
    {
        "mysql": _H4.format(extra=""),
        "oracle": _H4.format(extra=""),
        "pg": _H4.format(extra=", bool_and(l_linestatus = 'F') AS all_final"),
    },
)
def rollup_totals(t: Tables, dialect: str) -> DataFrame:
    final = F.bool_and(F.col("l_linestatus") == "F")
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).alias("q"), final.alias("f")
    )
    joined = (
        pairs.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )
    # the leaves first: rollup then triples a few hundred rows and not the fact table
    leaves = joined.groupBy(F.col("n_name").alias("dept_name"), F.col("p_brand").alias("brand")).agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"), F.bool_and("f").alias("f")
    )
    aggs = [F.sum("n").alias("assignment_count"), F.sum("q").cast("double").alias("total_qty")]
    if dialect == "pg":
        aggs.append(F.bool_and("f").alias("all_final"))
    return rollup_labelled(leaves, ["dept_name", "brand"], aggs, {"dept_name": "[Total]", "brand": "[Subtotal]"})


# --- extra ------------------------------------------------------------------------

_X1 = """
    WITH e AS (SELECT c_custkey, c_nationkey, CAST(round(abs(c_acctbal)) AS BIGINT) + 1 AS salary FROM customer),
    a AS (SELECT o_custkey, CAST(floor(o_totalprice / 100000) AS BIGINT) + 1 AS hours FROM orders),
    m AS (SELECT c_nationkey, CAST(sum(salary) AS DOUBLE) / count(*) AS mean FROM e GROUP BY 1),
    s AS (
      SELECT n_name, CAST({log}(salary) AS DECIMAL(20,10)) AS log_salary,
             floor(CAST({rate} AS DECIMAL(28,8)) * 100) / 100.0 AS hourly_rate,
             {greatest} AS effective_salary
      FROM e JOIN nation ON e.c_nationkey = n_nationkey JOIN m ON m.c_nationkey = e.c_nationkey
      LEFT JOIN a ON c_custkey = o_custkey)
    SELECT n_name, count(*) AS emp_count,
           floor(CAST(CAST(sum(log_salary) AS DOUBLE) / count(*) AS DECIMAL(28,8)) * 10000) / 10000.0 AS avg_log_salary,
           floor(CAST(CAST(sum(CAST(hourly_rate AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS DECIMAL(28,8)) * 100) / 100.0 AS avg_hourly_rate,
           CAST(sum(CASE WHEN effective_salary IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_salary_count
    FROM s GROUP BY n_name
    """
_FRACTION = "CAST(salary AS DOUBLE) / coalesce(hours, 1)"


@per_dialect(
    "x1_salary_analysis",
    {
        "mysql": _X1.format(log="ln", rate=_FRACTION, greatest="CAST(NULL AS DOUBLE)"),
        "pg": _X1.format(log="log10", rate="salary // coalesce(hours, 1)", greatest="greatest(salary, mean)"),
        "oracle": _X1.format(log="ln", rate=_FRACTION, greatest="greatest(salary, mean)"),
    },
)
def salary_analysis(t: Tables, dialect: str) -> DataFrame:
    one = F.lit(1).cast("bigint")
    people = t.customer.select(
        "c_custkey", "c_nationkey", (F.round(F.abs("c_acctbal"), 0).cast("bigint") + one).alias("salary")
    )
    mean = people.groupBy("c_nationkey").agg((F.sum("salary").cast("double") / F.count(F.lit(1))).alias("mean"))
    staff = people.join(checked_broadcast(cut(mean)), "c_nationkey").join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    work = t.orders.select(
        F.col("o_custkey").alias("c_custkey"),
        (F.floor(F.col("o_totalprice") / 100000) + one).alias("hours"),
    )
    # customer LEFT JOIN orders, taken from the order side so that a customer with
    # very many orders is looked up and not gathered
    busy = lookup_join(work, staff, ["c_custkey"], counted=True)
    idle = staff.join(work.select("c_custkey").distinct(), "c_custkey", "left_anti").withColumn(
        "hours", F.lit(None).cast("bigint")
    )
    rows = busy.unionByName(idle.select(busy.columns))
    hours = d.null_substitute("hours", one)
    analysis = rows.select(
        "n_name",
        d.log("salary", dialect).cast("decimal(20,10)").alias("log_salary"),
        d.truncate(d.divide("salary", hours, dialect, integers=True), 2).cast("decimal(20,2)").alias("hourly_rate"),
        d.greatest(
            F.col("salary").cast("double"), "mean", F.lit(None).cast("double"), dialect=dialect
        ).alias("effective_salary"),
    )
    grouped = analysis.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("emp_count"),
        F.sum("log_salary").alias("l"),
        F.sum("hourly_rate").alias("h"),
        F.sum(F.when(F.col("effective_salary").isNull(), 1).otherwise(0)).alias("null_salary_count"),
    )
    n = F.col("emp_count")
    return grouped.select(
        "n_name",
        "emp_count",
        d.truncate(F.col("l").cast("double") / n, 4).alias("avg_log_salary"),
        d.truncate(F.col("h").cast("double") / n, 2).alias("avg_hourly_rate"),
        "null_salary_count",
    )


_X2_RANKED = f"""
    WITH w AS (
      SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS work_month, strftime(o_orderdate, '%A, %B %d, %Y') AS formatted_date,
             sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent
      FROM orders WHERE o_orderdate >= DATE '{ORDERS_AS_OF}' - INTERVAL 12 MONTH GROUP BY 1, 2, 3),
    r AS (
      SELECT w.*, c_name, n_name, rank() OVER (PARTITION BY work_month ORDER BY spent DESC) AS month_rank,
             CASE WHEN spent > 400000 THEN 'overtime' ELSE 'normal' END AS work_type
      FROM w JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_name, work_month, string_agg(c_name, ', ' ORDER BY month_rank, c_name) AS top_workers,
           CAST(sum(spent) AS DOUBLE) AS total_spent,
           CAST(sum(CASE WHEN work_type = 'overtime' THEN 1 ELSE 0 END) AS BIGINT) AS overtime_count
    FROM r WHERE month_rank <= 3 GROUP BY 1, 2
    """


@per_dialect(
    "x2_ranked_or_densified",
    {
        "mysql": _X2_RANKED,
        "oracle": _X2_RANKED,
        "pg": """
    WITH m AS (SELECT CAST(gs AS DATE) AS month_start FROM generate_series(DATE '2024-01-01', DATE '2024-12-01', INTERVAL 1 MONTH) AS g(gs)),
    s AS (
      SELECT CAST(date_trunc('month', ts) AS DATE) AS work_month, event_type, sum(CAST(value AS DECIMAL(18,2))) AS total_value,
             count(DISTINCT user_id) FILTER (WHERE value > 4) AS productive_users,
             sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE json_extract_string(props, '$.k') LIKE '1%') AS tagged_value
      FROM events GROUP BY 1, 2)
    SELECT strftime(month_start, '%B %Y') AS month_label, event_type, CAST(coalesce(total_value, 0) AS DOUBLE) AS total_value,
           CAST(coalesce(productive_users, 0) AS INTEGER) AS productive_users,
           CAST(coalesce(tagged_value, 0) AS DOUBLE) AS tagged_value, strftime(month_start, '%A, %d %B %Y') AS full_date
    FROM m LEFT JOIN s ON work_month = month_start
    """,
    },
)
def ranked_or_densified(t: Tables, dialect: str) -> DataFrame:
    if dialect == "pg":
        big = F.col("value") > 4
        tagged = d.json_text("props", "$.k").like("1%")
        stats = t.events.groupBy(d.date_trunc("month", "ts").alias("month_start"), "event_type").agg(
            F.sum(money("value")).cast("double").alias("total_value"),
            F.count_distinct(F.when(big, F.col("user_id"))).cast("int").alias("productive_users"),
            F.sum(F.when(tagged, money("value"))).cast("double").alias("tagged_value"),
        )
        zeros = {"total_value": 0.0, "productive_users": 0, "tagged_value": 0.0}
        months = densify(stats, "month_start", day("2024-01-01"), day("2024-12-01"), "1 MONTH", zeros)
        return months.select(
            d.date_format("month_start", "Month YYYY", "pg").alias("month_label"),
            "event_type",
            *zeros,
            d.date_format("month_start", "Day, DD Month YYYY", "pg").alias("full_date"),
        )
    month, full = ("%Y-%m", "%W, %M %d, %Y") if dialect == "mysql" else ("YYYY-MM", "Day, Month DD, YYYY")
    start = (
        d.shift_months(day(ORDERS_AS_OF), -12)
        if dialect == "mysql"
        else d.shift_months(d.date_trunc("month", day(ORDERS_AS_OF)), -12)
    )
    work = (
        t.orders.filter(F.col("o_orderdate") >= start.cast("timestamp_ntz"))
        .groupBy(
            "o_custkey",
            d.date_format("o_orderdate", month, dialect).alias("work_month"),
            d.date_format("o_orderdate", full, dialect).alias("formatted_date"),
        )
        .agg(F.sum(money("o_totalprice")).alias("spent"))
    )
    top = rank_top(work, ["work_month"], [F.col("spent").desc()], 3, "month_rank")
    named = top.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return named.groupBy("n_name", "work_month").agg(
        ordered_list("c_name", "month_rank").alias("top_workers"),
        F.sum("spent").cast("double").alias("total_spent"),
        F.sum(F.when(F.col("spent") > 400000, 1).otherwise(0)).alias("overtime_count"),
    )


_X3_TREE = """
    WITH RECURSIVE e AS (
      SELECT c_custkey, CASE WHEN c_custkey = 0 THEN NULL ELSE CAST(floor(c_custkey / 10) AS BIGINT) END AS manager, {dept} AS dept
      FROM customer),
    o AS (
      SELECT c_custkey, dept, {root} AS depth FROM e WHERE manager IS NULL
      UNION ALL SELECT e.c_custkey, e.dept, o.depth + 1 FROM e JOIN o ON e.manager = o.c_custkey),
    n AS (SELECT n_nationkey, n_name, CAST((n_nationkey + 1) * 10000 + 0.25 AS DECIMAL(12,2)) AS budget,
                 DATE '2020-01-15' + n_nationkey * 20 AS created_at FROM nation)
    SELECT n_name, count(o.c_custkey) AS headcount, {budget} AS budget_str,
           CAST(round(coalesce(CAST(budget AS DOUBLE) / nullif(count(o.c_custkey), 0), 0)) AS BIGINT) AS per_head_int,
           last_day(created_at) AS budget_month_end, CAST(max(depth) AS INTEGER) AS deepest
    FROM n LEFT JOIN o ON o.dept = n_nationkey GROUP BY n_name, budget, created_at
    """


@per_dialect(
    "x3_hierarchy_or_array_agg",
    {
        "mysql": _X3_TREE.format(dept="nullif(c_nationkey, 3)", root=0, budget="CAST(budget AS VARCHAR)"),
        "oracle": _X3_TREE.format(dept="c_nationkey", root=1, budget="format('{:,.2f}', CAST(budget AS DOUBLE))"),
        "pg": f"""
    WITH ap AS (
      SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
      ORDER BY o_custkey, o_totalprice DESC, o_orderkey),
    firsts AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1),
    s AS (
      SELECT n_name, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS member_names,
             CAST(date_sub('year', CAST(min(first) AS DATE), DATE '{ORDERS_AS_OF}') AS INTEGER) AS max_tenure,
             count(*) FILTER (WHERE ap.o_orderkey IS NOT NULL) AS active_count
      FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ap ON ap.o_custkey = c_custkey
      LEFT JOIN firsts ON firsts.o_custkey = c_custkey
      WHERE regexp_matches(c_mktsegment, '^[A-H]+') GROUP BY n_name)
    SELECT * FROM s WHERE max_tenure >= 2
    """,
    },
)
def hierarchy_or_array_agg(t: Tables, dialect: str) -> DataFrame:
    if dialect == "pg":
        best = distinct_on(
            t.orders.filter(F.col("o_orderstatus") == "O").select("o_custkey", "o_orderkey", "o_totalprice"),
            ["o_custkey"],
            [F.col("o_totalprice").desc(), F.col("o_orderkey")],
        ).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
        firsts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first"))
        people = (
            t.customer.filter(F.col("c_mktsegment").rlike("^[A-H]+"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(best, "c_custkey", "left")
            .join(firsts, "c_custkey", "left")
        )
        return (
            people.groupBy("n_name")
            .agg(
                distinct_list("c_mktsegment").alias("member_names"),
                d.whole_years(day(ORDERS_AS_OF), F.min("first")).alias("max_tenure"),
                F.count("o_orderkey").alias("active_count"),
            )
            .filter(F.col("max_tenure") >= 2)
        )
    manager = F.when(F.col("c_custkey") != 0, F.floor(F.col("c_custkey") / 10))
    dept = F.nullif(F.col("c_nationkey"), F.lit(3)) if dialect == "mysql" else F.col("c_nationkey")
    staff = t.customer.select("c_custkey", manager.alias("manager"), dept.alias("dept"))
    tree = hierarchy(staff, "c_custkey", "manager", root_level=0 if dialect == "mysql" else 1)
    heads = tree.groupBy("dept").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))
    depts = t.nation.select(
        "n_nationkey",
        "n_name",
        ((F.col("n_nationkey") + 1) * 10000 + F.lit(0.25)).cast("decimal(12,2)").alias("budget"),
        F.date_add(F.lit("2020-01-15").cast("date"), F.col("n_nationkey") * 20).alias("created_at"),
    )
    headcount = F.coalesce("n", F.lit(0).cast("bigint"))
    per_head = d.divide(F.col("budget").cast("double"), headcount, dialect)
    budget = d.to_text("budget") if dialect == "mysql" else d.number_format("budget", 2, dialect)
    out = depts.join(heads, depts["n_nationkey"] == heads["dept"], "left").select(
        "n_name",
        headcount.alias("headcount"),
        budget.alias("budget_str"),
        d.to_signed(d.null_substitute(per_head, F.lit(0.0))).alias("per_head_int"),
        d.last_day("created_at").alias("budget_month_end"),
        "deepest",
    )
    return out


_X4 = """
    SELECT lang, doc_id, strlen(text) AS byte_len, length(text) AS char_len,
           md5(regexp_replace(text, '[^a-zA-Z0-9@.]', ''{scope})) AS clean_md5, hex(left(text, 4)) AS name_hex,
           row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS byte_rank
    FROM documents WHERE lang IN ('en', 'fr', 'de')
    """


@per_dialect(
    "x4_bytes_regex_hex_row_number",
    {"mysql": _X4.format(scope=", 'g'"), "pg": _X4.format(scope=", 'g'"), "oracle": _X4.format(scope="")},
)
def bytes_regex_hex(t: Tables, dialect: str) -> DataFrame:
    lang = F.col("lang")
    member = {
        "mysql": d.in_csv(lang, "en,fr,de"),
        "pg": F.array_contains(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), lang),
        "oracle": lang.isin("en", "fr", "de"),
    }[dialect]
    cleaned = d.regexp_replace("text", "[^a-zA-Z0-9@.]", "", dialect, flags="g" if dialect == "pg" else "")
    people = spread(t.documents.filter(member).select("lang", "doc_id", "source", "text"))
    tagged = people.select(
        "lang",
        "doc_id",
        "source",
        d.length("text", "mysql").cast("bigint").alias("byte_len"),
        d.length("text", "pg").cast("bigint").alias("char_len"),
        F.md5(cleaned).alias("clean_md5"),
        d.hex_text(F.left("text", F.lit(4))).alias("name_hex"),
    )
    # written once: the range sort reads its input twice, and the texts are long
    return row_numbers(store(tagged), ["source"], [F.col("byte_len").desc(), F.col("doc_id")], "byte_rank").drop("source")
