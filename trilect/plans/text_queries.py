"""Queries over columns of query text and page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilect.functions import sqltext as x
from trilect.operators.relational import top_per_key
from trilect.plans.derived import QUERY_TEXTS
from trilect.plans.registry import Tables, plain, query
from trilect.session import spread



def _pinned(dialect: str, rules: list[tuple[str, str]]) -> str:
    """The replacement chain for an engine without lookbehind: aliases are marked, kept and unmarked."""
    out = "regexp_replace(sql, '\\b(AS\\s+current_)(date|timestamp|time)\\b', '\\1@\\2', 'gi')"
    for pattern, constant in rules:
        out = f"regexp_replace({out}, '{pattern}', '{constant}', 'gi')"
    return f"regexp_replace({out}, '\\b(AS\\s+current_)@', '\\1', 'gi')"


_TS, _D = "''2024-06-15 00:00:00''", "''2024-06-15''"
_NOW_ORACLE = f"TO_TIMESTAMP({_TS}, ''YYYY-MM-DD HH24:MI:SS'')"
_MYSQL = [
    (r"\bNOW\s*\(\s*\)", _TS), (r"\bCURDATE\s*\(\s*\)", _D), (r"\bCURRENT_DATE\b(?:\s*\(\s*\))?", _D),
    (r"\bCURRENT_TIMESTAMP\b(?:\s*\(\s*\))?", _TS), (r"\bUTC_DATE\s*\(\s*\)", _D), (r"\bSYSDATE\s*\(\s*\)", _TS),
]
_PG = [
    (r"\bNOW\s*\(\s*\)", f"{_TS}::timestamp"), (r"\bCURRENT_DATE\b", f"{_D}::date"), (r"\bLOCALTIMESTAMP\b", f"{_TS}::timestamp"),
    (r"\bLOCALTIME\b", "''00:00:00''::time"), (r"\bCURRENT_TIME\b", "''00:00:00''::time"),
]
_ORACLE = [
    (r"\bSYSDATE\b", _NOW_ORACLE), (r"\bCURRENT_DATE\b", f"TO_DATE({_D}, ''YYYY-MM-DD'')"),
    (r"\bSYSTIMESTAMP\b", "TO_TIMESTAMP_TZ(''2024-06-15 00:00:00 +00:00'', ''YYYY-MM-DD HH24:MI:SS TZH:TZM'')"),
]


@query(
    "T1_pin_time",
    f"""SELECT query_id, CASE dialect WHEN 'mysql' THEN {_pinned('mysql', _MYSQL)} WHEN 'pg' THEN {_pinned('pg', _PG)}
        ELSE {_pinned('oracle', _ORACLE)} END AS sql FROM ({plain(QUERY_TEXTS)}) q""",
)
def pin_time(t: Tables) -> DataFrame:
    return spread(t.sql(QUERY_TEXTS)).select("query_id", x.pin_time("sql", "dialect").alias("sql"))


@query(
    "T2_pin_random",
    rf"""SELECT query_id, CASE dialect
        WHEN 'mysql' THEN regexp_replace(sql, '\bRAND\s*\(\s*\d*\s*\)', '(SELECT 0.5)', 'gi')
        WHEN 'pg' THEN regexp_replace(sql, '\bRANDOM\s*\(\s*\)', '(SELECT 0.5)', 'gi')
        ELSE regexp_replace(regexp_replace(sql, '\bDBMS_RANDOM\.RANDOM\b', '(SELECT 42 FROM DUAL)', 'gi'),
             '\bDBMS_RANDOM\.VALUE\b(?:\s*\([^)]*\))?', '(SELECT 0.5)', 'gi') END AS sql FROM ({plain(QUERY_TEXTS)}) q""",
)
def pin_random(t: Tables) -> DataFrame:
    return t.sql(QUERY_TEXTS).select("query_id", x.pin_random("sql", "dialect").alias("sql"))


def _without_lines(s: str, prefix: str) -> str:
    return f"array_to_string(list_filter(string_split({s}, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*({prefix})')), chr(10))"


_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"


@query(
    "T3_clean_sql",
    f"""SELECT query_id, {_STRIP.format("regexp_replace(" + _STRIP.format(
        "regexp_replace(" + _without_lines("sql", "--|#") + ", '/\\*(?s:.*?)\\*/', '', 'g')") + ", ';+$', '')")} AS sql FROM ({plain(QUERY_TEXTS)}) q""",
)
def clean_sql(t: Tables) -> DataFrame:
    return t.sql(QUERY_TEXTS).select("query_id", x.clean_sql("sql").alias("sql"))


@query(
    "T4_split_statements",
    f"""WITH b AS (SELECT query_id, list_filter(list_transform(string_split(sql, ';'), lambda s: {_STRIP.format(_without_lines("s", "--"))}), lambda s: s <> '') AS parts
                   FROM ({plain(QUERY_TEXTS)}) q)
        SELECT query_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS ordinal, unnest(parts) AS statement FROM b""",
)
def split_statements(t: Tables) -> DataFrame:
    return x.split_statements(t.sql(QUERY_TEXTS), "sql", ["query_id"])


_PAGE_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x0b\p{Z}]+', ' ', 'g'))"""


@query("T5_html_to_text", f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages")
def page_text(t: Tables) -> DataFrame:
    return spread(t.pages).select("page_id", x.html_to_text("html").alias("text"))


_QUIET = "html"
for _tag in x.NOISE_ELEMENTS:
    _QUIET = rf"regexp_replace({_QUIET}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'g')"
_MAIN = ", ".join(rf"nullif(regexp_extract(html, '(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>', 1), '')" for tag in x.MAIN_ELEMENTS)


@query(
    "T5_main_text",
    f"""WITH q AS (SELECT page_id, {_QUIET} AS html FROM pages), m AS (SELECT page_id, coalesce({_MAIN}, html) AS html FROM q)
        SELECT page_id, {_PAGE_TEXT} AS text FROM m""",
)
def main_text(t: Tables) -> DataFrame:
    return spread(t.pages).select("page_id", x.main_text("html").alias("text"))


_LINKED = "SELECT page_id, html, CASE WHEN page_id % 9 = 0 THEN replace(url, '.example.', '.reddit.') ELSE url END AS url FROM {pages}"


@query(
    "T6_keep_page",
    rf"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
        NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), 'x\.com|reddit\.com|google\.com|apple\.com')
        AND length({_PAGE_TEXT}) >= 100 AS keep FROM ({plain(_LINKED)}) p""",
)
def keep_page(t: Tables) -> DataFrame:
    pages = spread(t.sql(_LINKED)).withColumn("text", x.html_to_text("html"))
    return pages.select("page_id", x.page_host("url").alias("host"), x.keep_page("url", "text").alias("keep"))


_CORPUS = f"""
    SELECT query_id, dialect, difficulty, sql, split('D' || CAST(query_id % 7 AS STRING) || '.1,D' || CAST(query_id % 11 AS STRING) || '.2', ',') AS features,
           split(CASE WHEN query_id % 2 = 0 THEN 'COUNT,SUM' ELSE 'LAG' END, ',') AS functions FROM ({QUERY_TEXTS}) q
    """


@query(
    "T7_feature_coverage",
    f"""WITH c AS ({plain(_CORPUS)}), f AS (SELECT dialect, unnest(features) AS i FROM c), g AS (SELECT dialect, unnest(functions) AS i FROM c)
        SELECT dialect, count(*) AS total, count(*) FILTER (WHERE difficulty = 'easy') AS n_easy, count(*) FILTER (WHERE difficulty = 'medium') AS n_medium,
          count(*) FILTER (WHERE difficulty = 'hard') AS n_hard, count(*) FILTER (WHERE difficulty = 'extra') AS n_extra,
          count(*) FILTER (WHERE regexp_matches(upper(sql), 'WHERE|HAVING|LIKE|REGEXP|~')) AS with_filter,
          (SELECT count(DISTINCT i) FROM f WHERE f.dialect = c.dialect) AS n_features,
          (SELECT count(DISTINCT i) FROM g WHERE g.dialect = c.dialect) AS n_functions FROM c GROUP BY dialect""",
)
def coverage(t: Tables) -> DataFrame:
    return x.feature_coverage(t.sql(_CORPUS))


@query(
    "T7_covered_items",
    f"""WITH c AS ({plain(_CORPUS)}) SELECT DISTINCT dialect, 'feature' AS kind, unnest(features) AS item FROM c
        UNION SELECT DISTINCT dialect, 'function', unnest(functions) FROM c""",
)
def covered(t: Tables) -> DataFrame:
    return x.covered_items(t.sql(_CORPUS))


@query(
    "T8_pick_examples",
    f"""SELECT dialect, difficulty, query_id FROM ({plain(QUERY_TEXTS)}) q
        QUALIFY row_number() OVER (PARTITION BY dialect, difficulty ORDER BY query_id) <= 2""",
)
def pick_examples(t: Tables) -> DataFrame:
    rows = t.sql(QUERY_TEXTS).select("dialect", "difficulty", "query_id")
    return top_per_key(rows, ["dialect", "difficulty"], [F.col("query_id")], 2)


@query(
    "T9_strip_markup",
    """SELECT page_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS text, left(t, 300) AS longer
       FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)""",
)
def strip_markup(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", x.strip_markup("html", 200).alias("text"), x.strip_markup("html", 300, dots=False).alias("longer")
    )
