"""One query per scalar function and dialect meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilect.functions import dialect as d
from trilect.plans.corpus import ORDERS_AS_OF, day
from trilect.plans.registry import Tables, per_dialect, query


def _round(c):
    return F.round(c, 6)


@per_dialect(
    "D1_log",
    {
        "mysql": "SELECT o_orderkey, round(ln(o_totalprice), 6) AS v FROM orders",
        "pg": "SELECT o_orderkey, round(log10(o_totalprice), 6) AS v FROM orders",
        "oracle": "SELECT o_orderkey, round(ln(o_totalprice), 6) AS v FROM orders",
    },
)
def log(t: Tables, dialect: str) -> DataFrame:
    return t.orders.select("o_orderkey", _round(d.log("o_totalprice", dialect)).alias("v"))


@per_dialect(
    "D2_length",
    {
        "mysql": "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n FROM documents",
        "pg": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents",
        "oracle": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents",
    },
)
def length(t: Tables, dialect: str) -> DataFrame:
    return t.documents.select("doc_id", d.length("text", dialect).alias("n"))


_GREATEST = "SELECT c_custkey, {} AS v FROM (SELECT *, nullif(c_nationkey, 3) AS a, CAST(c_custkey % 25 AS INTEGER) AS b FROM customer)"


@per_dialect(
    "D3_greatest",
    {
        "mysql": _GREATEST.format("CASE WHEN a IS NULL THEN NULL ELSE greatest(a, b) END"),
        "pg": _GREATEST.format("greatest(a, b)"),
        "oracle": _GREATEST.format("greatest(a, b)"),
    },
)
def greatest(t: Tables, dialect: str) -> DataFrame:
    a, b = F.nullif(F.col("c_nationkey"), F.lit(3)), (F.col("c_custkey") % 25).cast("int")
    return t.customer.select("c_custkey", d.greatest(a, b, dialect=dialect).alias("v"))


_DIVIDE = "SELECT l_orderkey, l_linenumber, {} AS v FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


@per_dialect(
    "D4_integer_division",
    {
        "mysql": _DIVIDE.format("q / l_linenumber"),
        "pg": _DIVIDE.format("q // l_linenumber"),
        "oracle": _DIVIDE.format("q / l_linenumber"),
    },
)
def integer_division(t: Tables, dialect: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("bigint")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", d.divide(quantity, "l_linenumber", dialect, integers=True).alias("v")
    )


@query("D5_division_by_zero_mysql", "SELECT c_custkey, c_acctbal / nullif(c_custkey % 5, 0) AS v FROM customer")
def division_by_zero(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", d.divide("c_acctbal", F.col("c_custkey") % 5, "mysql").alias("v"))


@per_dialect("D5_guarded_division", "SELECT c_custkey, c_acctbal / (c_custkey % 5 + 1) AS v FROM customer", ("pg", "oracle"))
def guarded_division(t: Tables, dialect: str) -> DataFrame:
    return t.customer.select("c_custkey", d.divide("c_acctbal", F.col("c_custkey") % 5 + 1, dialect).alias("v"))


_REPLACE = "SELECT doc_id, md5(regexp_replace(text, '[^a-zA-Z ]+', '_'{})) AS v FROM documents"


@per_dialect(
    "D6_regexp_replace",
    {"mysql": _REPLACE.format(", 'g'"), "pg": _REPLACE.format(""), "oracle": _REPLACE.format("")},
)
def regexp_replace(t: Tables, dialect: str) -> DataFrame:
    return t.documents.select("doc_id", F.md5(d.regexp_replace("text", "[^a-zA-Z ]+", "_", dialect)).alias("v"))


@query(
    "D6_regexp_replace_groups_pg",
    r"SELECT doc_id, md5(regexp_replace(text, '([a-z]+) ([a-z]+)', '\2 \1')) AS v FROM documents",
)
def regexp_groups(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(d.regexp_replace("text", "([a-z]+) ([a-z]+)", r"\2 \1", "pg")).alias("v"))


@per_dialect(
    "D6_regexp_replace_dollar",
    {d_: rf"SELECT doc_id, md5(regexp_replace(text, '([a-z]+)[.]', '$1 \1 $'{g})) AS v FROM documents" for d_, g in (("pg", ""), ("oracle", ""))},
    ("pg", "oracle"),
)
def regexp_dollar(t: Tables, dialect: str) -> DataFrame:
    return t.documents.select("doc_id", F.md5(d.regexp_replace("text", "([a-z]+)[.]", r"$1 \1 $", dialect)).alias("v"))


@query("D7_null_substitute", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS v FROM customer")
def null_substitute(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", d.null_substitute(F.nullif(F.col("c_nationkey"), F.lit(3)), F.lit(-1)).alias("v")
    )


_CONCAT = "SELECT c_custkey, {} AS v FROM (SELECT *, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS s FROM customer)"


@per_dialect(
    "D8_concat",
    {
        "mysql": _CONCAT.format("c_name || '/' || s"),
        "pg": _CONCAT.format("c_name || '/' || s"),
        "oracle": _CONCAT.format("c_name || '/' || coalesce(s, '')"),
    },
)
def concat(t: Tables, dialect: str) -> DataFrame:
    segment = F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", d.concat("c_name", F.lit("/"), segment, dialect=dialect).alias("v"))


@query(
    "D9_truncate",
    """SELECT s_suppkey, sign(x) * floor(abs(x) * 10) / 10.0 AS v FROM
       (SELECT s_suppkey, CAST(s_acctbal / 7 - 300 AS DECIMAL(28,8)) AS x FROM supplier)""",
)
def truncate(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", d.truncate(F.col("s_acctbal") / 7 - 300, 1).alias("v"))


@query(
    "D9_truncate_places",
    """SELECT c_custkey, trunc(c_acctbal / 100) * 100 + 0 AS hundreds, c_acctbal * 1e18 AS huge,
              CAST('-' || c_custkey || '.123456789012' AS DOUBLE) AS places FROM customer""",
)
def truncate_places(t: Tables) -> DataFrame:
    long = F.concat(F.lit("-"), F.col("c_custkey").cast("string"), F.lit(".123456789012987")).cast("decimal(25,15)")
    return t.customer.select(
        "c_custkey",
        d.truncate("c_acctbal", -2).alias("hundreds"),
        d.truncate(F.col("c_acctbal") * F.lit(1e18), 2).alias("huge"),
        d.truncate(long, 12).alias("places"),
    )


_FORMAT = "SELECT event_id, strftime(ts, '{}') AS v FROM events"


@per_dialect(
    "D10_date_format",
    {
        "mysql": _FORMAT.format("%A, %B %d, %Y %I:%M %p"),
        "pg": _FORMAT.format("%A, %B %d, %Y %I:%M %p"),
        "oracle": _FORMAT.format("%A, %B %d, %Y %I:%M %p"),
    },
)
def date_format(t: Tables, dialect: str) -> DataFrame:
    pattern = "%W, %M %d, %Y %h:%i %p" if dialect == "mysql" else "Day, Month DD, YYYY HH12:MI AM"
    return t.events.select("event_id", d.date_format("ts", pattern, dialect).alias("v"))


@query(
    "D10_date_format_blank_padded",
    """SELECT event_id, rpad(strftime(ts, '%A'), 9, ' ') || ', ' || rpad(upper(strftime(ts, '%B')), 9, ' ') || strftime(ts, ' %d') AS v FROM events""",
)
def padded_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", d.date_format("ts", "Day, MONTH DD", "oracle", blank_padded=True).alias("v"))


@per_dialect(
    "D10_date_format_codes",
    {
        "mysql": "SELECT event_id, strftime(ts, '%a %b %-d %j %H:%M:%S %y %-m') AS v FROM events",
        "oracle": "SELECT event_id, strftime(ts, '%a %b %d %j %H:%M:%S %y') || ' Q ' || quarter(ts) AS v FROM events",
    },
    ("mysql", "oracle"),
)
def date_codes(t: Tables, dialect: str) -> DataFrame:
    pattern = "%a %b %e %j %T %y %c" if dialect == "mysql" else 'Dy Mon DD DDD HH24:MI:SS YY "Q" Q'
    return t.events.select("event_id", d.date_format("ts", pattern, dialect).alias("v"))


@query(
    "D11_date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
              CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders""",
)
def date_parts(t: Tables) -> DataFrame:
    part = d.date_part
    return t.orders.select(
        "o_orderkey", part("YEAR", "o_orderdate").alias("y"), part("MONTH", "o_orderdate").alias("m"),
        part("QUARTER", "o_orderdate").alias("q"),
    )


@query(
    "D12_date_difference",
    "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01') AS INTEGER) AS v FROM lineitem",
)
def date_difference(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", d.days_between(day("2002-01-01"), "l_shipdate").alias("v"))


@query(
    "D13_interval_days",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL 45 DAY AS DATE) AS b
       FROM orders""",
)
def interval_days(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        d.shift_days("o_orderdate", d.interval_days("INTERVAL '30 days'")).alias("a"),
        d.shift_days("o_orderdate", -d.interval_days("INTERVAL '45' DAY")).alias("b"),
    )


@query(
    "D14_add_months",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 7 MONTH AS DATE) AS v FROM orders",
)
def add_months(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", d.shift_months("o_orderdate", -7).alias("v"))


@query(
    "D15_date_trunc",
    """SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS m, CAST(date_trunc('quarter', ts) AS DATE) AS q,
              CAST(date_trunc('year', ts) AS DATE) AS y FROM events""",
)
def date_trunc(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[d.date_trunc(u, "ts").alias(u[0]) for u in ("month", "quarter", "year")])


@query("D16_last_day", "SELECT o_orderkey, last_day(o_orderdate) AS v FROM orders")
def last_day(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", d.last_day("o_orderdate").alias("v"))


@query(
    "D17_whole_years",
    f"SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}') AS INTEGER) AS v FROM orders",
)
def whole_years(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", d.whole_years(day(ORDERS_AS_OF), "o_orderdate").alias("v"))


@query(
    "D18_casts",
    """SELECT p_partkey, CAST(round(CAST(p_retailprice / 4 AS DECIMAL(28,8))) AS BIGINT) AS signed, CAST(p_size AS VARCHAR) AS text,
              CAST(round(CAST(p_retailprice / 4 AS DECIMAL(38,10)), 1) AS DOUBLE) AS numeric FROM part""",
)
def casts(t: Tables) -> DataFrame:
    quarter = F.col("p_retailprice") / 4
    return t.part.select(
        "p_partkey",
        d.to_signed(quarter).alias("signed"),
        d.to_text("p_size").alias("text"),
        d.to_numeric(quarter, 12, 1).cast("double").alias("numeric"),
    )


@per_dialect(
    "D19_number_format",
    "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS v FROM orders",
    ("mysql", "oracle"),
)
def number_format(t: Tables, dialect: str) -> DataFrame:
    return t.orders.select("o_orderkey", d.number_format("o_totalprice", 2, dialect).alias("v"))


_SIGNED = "SELECT c_custkey, {} AS v, {} AS small FROM (SELECT *, format('{{:,.2f}}', c_acctbal) AS f, format('{{:,.2f}}', round(c_acctbal / 20000, 2) + 0.0) AS g FROM customer)"


@per_dialect(
    "D19_number_format_signed",
    {"mysql": _SIGNED.format("f", "g"), "oracle": _SIGNED.format(*[rf"regexp_replace({c}, '^(-?)0\.', '\1.')" for c in "fg"])},
    ("mysql", "oracle"),
)
def number_format_signed(t: Tables, dialect: str) -> DataFrame:
    small = F.round(F.col("c_acctbal") / 20000, 2)
    return t.customer.select("c_custkey", d.number_format("c_acctbal", 2, dialect).alias("v"), d.number_format(small, 2, dialect).alias("small"))


@per_dialect("D20_json_text", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events", ("mysql", "oracle"))
def json_text(t: Tables, dialect: str) -> DataFrame:
    value = d.json_text("props", "$.k") if dialect == "mysql" else d.json_text_by_regex("props", "k")
    return t.events.select("event_id", value.alias("v"))


@query("D21_hex", "SELECT doc_id, hex(left(text, 4)) AS v FROM documents")
def hex_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", d.hex_text(F.left("text", F.lit(4))).alias("v"))


@query(
    "D22_sign_substr_upper_left",
    """SELECT s_suppkey, CAST(sign(s_acctbal - 5000) AS INTEGER) AS sg, substr(s_name, 1, 4) AS sub, upper(s_name) AS up, left(s_name, 3) AS l
       FROM supplier""",
)
def plain_functions(t: Tables) -> DataFrame:
    return t.supplier.select(
        "s_suppkey",
        F.signum(F.col("s_acctbal") - 5000).cast("int").alias("sg"),
        F.substring("s_name", 1, 4).alias("sub"),
        F.upper("s_name").alias("up"),
        F.left("s_name", F.lit(3)).alias("l"),
    )


@query(
    "D23_nvl2",
    "SELECT c_custkey, CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN 'known' ELSE 'unknown' END AS v FROM customer",
)
def nvl2(t: Tables) -> DataFrame:
    value = d.nvl2(F.nullif(F.col("c_nationkey"), F.lit(3)), F.lit("known"), F.lit("unknown"))
    return t.customer.select("c_custkey", value.alias("v"))


_EMPTY = "SELECT c_custkey, {} AS v FROM (SELECT *, CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS s FROM customer)"


@per_dialect(
    "D24_empty_string",
    {"mysql": _EMPTY.format("s"), "pg": _EMPTY.format("s"), "oracle": _EMPTY.format("nullif(s, '')")},
)
def empty_string(t: Tables, dialect: str) -> DataFrame:
    text = F.when(F.col("c_nationkey") == 3, F.lit("")).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", d.empty_as_null(text, dialect).alias("v"))


@query(
    "D25_pinned_constants",
    """SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-06-15') AS INTEGER) AS age, 0.5::DOUBLE * value AS half,
              event_id % 42 AS bucket, ts < TIMESTAMP '2024-06-15 00:00:00' AS past FROM events""",
)
def pinned(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        d.days_between(d.pinned_today(), "ts").alias("age"),
        (d.pinned_random() * F.col("value")).alias("half"),
        (F.col("event_id") % d.pinned_random_integer()).alias("bucket"),
        (F.col("ts") < d.pinned_now()).alias("past"),
    )





@query(
    "D18_rounded_once",
    """SELECT p_partkey, CAST(p_partkey AS BIGINT) AS below, CAST(p_partkey + 1 AS BIGINT) AS half, 9223372036854775807 AS large,
              CAST(p_partkey AS VARCHAR) || '.4' AS tenth FROM part""",
)
def rounded_once(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("double")
    return t.part.select(
        "p_partkey",
        d.to_signed(key + 0.499999999).alias("below"),
        d.to_signed(key + 0.5).alias("half"),
        d.to_signed((key + 1) * 1e21).alias("large"),
        d.to_numeric(F.concat(F.col("p_partkey").cast("string"), F.lit(".449999999999999")), 20, 1).cast("string").alias("tenth"),
    )
