"""Columns over query text and page text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.functions.columns import as_column
from trilect.functions.dialect import FIXED_DATE, FIXED_TIMESTAMP

_NO_CALL = r"(?!\s*\()"
_CALL = r"\s*\(\s*\)"
_ORACLE_NOW = f"TO_TIMESTAMP('{FIXED_TIMESTAMP}', 'YYYY-MM-DD HH24:MI:SS')"

# The clock functions of each dialect by what they give, and the constants
# that replace them. A name with () is a call, with (?) it may be one, else it is a word.
CLOCK_NAMES = {
    "mysql": {
        "date": ["CURDATE()", "CURRENT_DATE(?)", "UTC_DATE()"],
        "time": ["CURTIME()"],
        "timestamp": ["NOW()", "CURRENT_TIMESTAMP(?)", "SYSDATE()", "UTC_TIMESTAMP()"],
    },
    "pg": {
        "date": ["CURRENT_DATE"],
        "time": ["CURRENT_TIME", "LOCALTIME"],
        "timestamp": ["NOW()", "CURRENT_TIMESTAMP", "LOCALTIMESTAMP"],
    },
    "oracle": {
        "date": ["CURRENT_DATE"],
        "timestamp": ["CURRENT_TIMESTAMP", "LOCALTIMESTAMP", "SYSDATE"],
        "zoned": ["SYSTIMESTAMP"],
    },
}
CLOCK_CONSTANTS = {
    "mysql": {"date": f"'{FIXED_DATE}'", "time": "'00:00:00'", "timestamp": f"'{FIXED_TIMESTAMP}'"},
    "pg": {"date": f"'{FIXED_DATE}'::date", "time": "'00:00:00'::time", "timestamp": f"'{FIXED_TIMESTAMP}'::timestamp"},
    "oracle": {
        "date": f"TO_DATE('{FIXED_DATE}', 'YYYY-MM-DD')",
        "timestamp": _ORACLE_NOW,
        "zoned": f"TO_TIMESTAMP_TZ('{FIXED_TIMESTAMP} +00:00', 'YYYY-MM-DD HH24:MI:SS TZH:TZM')",
    },
}
# Put before a name that is an alias, so that it is another word for the moment.
_ALIAS_MARK = "trilect__alias__"


def _clock_rules(dialect: str) -> list[tuple[str, str]]:
    """Aliases are marked, each kind of clock is replaced in one pass, and the marks go."""

    def pattern(name: str) -> str:
        bare = name.removesuffix("()").removesuffix("(?)")
        ends = {"()": _CALL, "?)": f"(?:{_CALL}|{_NO_CALL})"}.get(name[-2:], "")
        return rf"{bare}\b{ends}"

    kinds = CLOCK_NAMES[dialect]
    aliases = "|".join(n.rstrip("(?)") for names in kinds.values() for n in names if n.startswith("CURRENT_"))
    rules = [(rf"\b(AS\s+)(?=(?:{aliases})\b)", f"$1{_ALIAS_MARK}")]
    for kind, names in kinds.items():
        constant = re.sub(r"([\\$])", r"\\\1", CLOCK_CONSTANTS[dialect][kind])
        rules.append((rf"\b(?:{'|'.join(map(pattern, names))})", constant))
    return [*rules, (_ALIAS_MARK, "")]


CLOCK = {dialect: _clock_rules(dialect) for dialect in CLOCK_NAMES}

# Random functions with the numbers of arguments they are called with (None: no
# brackets), and the constant that replaces them.
RANDOM_CALLS = {
    "mysql": [("RAND", (1, 0), "(SELECT 0.5)")],
    "pg": [("RANDOM", (0,), "(SELECT 0.5)")],
    "oracle": [("DBMS_RANDOM.VALUE", (2, 0, None), "(SELECT 0.5)"), ("DBMS_RANDOM.RANDOM", (0, None), "(SELECT 42 FROM DUAL)")],
}


def _call(arguments: int | None) -> str:
    """Brackets with so many numbers, or none at all."""
    if arguments is None:
        return _NO_CALL
    numbers = r"\s*,\s*".join([r"[\d.]+"] * arguments)
    return rf"\s*\(\s*{numbers}\s*\)"


RANDOM = {
    dialect: [(rf"\b{re.escape(name)}\b(?:{'|'.join(map(_call, counts))})", constant) for name, counts, constant in calls]
    for dialect, calls in RANDOM_CALLS.items()
}


def _replace_all(sql: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        sql = F.regexp_replace(sql, f"(?i){pattern}", replacement)
    return sql


def _by_dialect(sql: str | Column, dialect: str | Column, rules: dict[str, list[tuple[str, str]]]) -> Column:
    sql, dialect = as_column(sql), as_column(dialect)
    return (
        F.when(dialect == "mysql", _replace_all(sql, rules["mysql"]))
        .when(dialect == "oracle", _replace_all(sql, rules["oracle"]))
        .otherwise(_replace_all(sql, rules["pg"]))
    )


def pin_time(sql: str | Column, dialect: str | Column) -> Column:
    """Clock functions replaced by fixed literals; ``AS current_date`` and its kin stay."""
    return _by_dialect(sql, dialect, CLOCK)


def pin_random(sql: str | Column, dialect: str | Column) -> Column:
    return _by_dialect(sql, dialect, RANDOM)


def strip_space(text: str | Column) -> Column:
    """Leading and trailing white space of any kind removed."""
    return F.regexp_replace(as_column(text), r"\A\s+|\s+\z", "")


def clean_sql(sql: str | Column) -> Column:
    """The statement alone: comment lines, block comments and closing semicolons removed."""
    lines = F.filter(F.split(as_column(sql), "\n"), lambda line: ~strip_space(line).rlike("^(--|#)"))
    bare = strip_space(F.regexp_replace(F.array_join(lines, "\n"), r"(?s)/\*.*?\*/", ""))
    return strip_space(F.regexp_replace(bare, r";+\z", ""))


def split_statements(df: DataFrame, sql: str, keep: list[str]) -> DataFrame:
    """(keep.., ordinal, statement): text between semicolons, without comment lines and empty pieces."""

    def without_comments(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda line: ~strip_space(line).startswith("--"))
        return strip_space(F.array_join(lines, "\n"))

    pieces = F.filter(F.transform(F.split(F.col(sql), ";"), without_comments), lambda s: s != "")
    split = df.select(*keep, F.posexplode_outer(pieces).alias("ordinal", "statement"))
    return split.filter(F.col("statement").isNotNull())


def html_to_text(html: str | Column, max_chars: int | None = None) -> Column:
    """Script and style dropped, tags replaced by blanks, white space collapsed; whole text unless cut."""
    text = as_column(html)
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return F.left(text, F.lit(max_chars)) if max_chars else text


# Elements without a page's own text, and those that hold it, by preference.
NOISE_ELEMENTS = ["script", "style", "noscript", "iframe", "svg", "nav", "header", "footer", "aside", "form"]
MAIN_ELEMENTS = ["article", "main", "body"]


def main_text(html: str | Column, max_chars: int | None = None) -> Column:
    """The text of a page's main part: without noise elements, from the first kind of main element it has, else from all."""
    text = as_column(html)
    for tag in NOISE_ELEMENTS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    inner = [F.nullif(F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit("")) for tag in MAIN_ELEMENTS]
    return html_to_text(F.coalesce(*inner, text), max_chars)


# Hosts whose pages are not used (matched anywhere in the host name).
SKIPPED_HOSTS = [
    "youtube.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "tiktok.com",
    "reddit.com", "pinterest.com", "amazon.com", "ebay.com", "google.com", "apple.com",
]
SHORTEST_PAGE = 100


def page_host(url: str | Column) -> Column:
    return F.lower(F.try_parse_url(as_column(url), F.lit("HOST")))


def keep_page(url: str | Column, text: str | Column) -> Column:
    """Whether a page is used: its host is not skipped and its text is long enough."""
    host = F.coalesce(page_host(url), F.lit(""))
    skipped = host.rlike("|".join(re.escape(h) for h in SKIPPED_HOSTS))
    return ~skipped & (F.char_length(text) >= SHORTEST_PAGE)


def strip_markup(text: str | Column, n: int, dots: bool = True) -> Column:
    """Tags removed and cut to ``n`` characters, with dots where something was cut."""
    bare = F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"<[^>]+>", "")
    cut = F.left(bare, F.lit(n))
    if not dots:
        return cut
    return F.when(F.char_length(bare) > n, F.concat(cut, F.lit("..."))).otherwise(bare)


FILTER_WORDS = r"WHERE|HAVING|LIKE|ILIKE|REGEXP|~"


def feature_coverage(corpus: DataFrame) -> DataFrame:
    """Per dialect: queries, queries per difficulty, queries with a filter, distinct features and functions."""
    per_dialect = corpus.groupBy("dialect").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("difficulty") == d).alias(f"n_{d}") for d in ("easy", "medium", "hard", "extra")],
        F.count_if(F.upper("sql").rlike(FILTER_WORDS)).alias("with_filter"),
    )
    items = covered_items(corpus).groupBy("dialect").agg(
        F.count_if(F.col("kind") == "feature").alias("n_features"),
        F.count_if(F.col("kind") == "function").alias("n_functions"),
    )
    return per_dialect.join(items, "dialect", "left").fillna(0, ["n_features", "n_functions"])


def covered_items(corpus: DataFrame) -> DataFrame:
    """Distinct (dialect, kind, item) over the feature and function lists of a query corpus."""
    tagged = F.concat(
        F.transform("features", lambda x: F.struct(F.lit("feature").alias("kind"), x.alias("item"))),
        F.transform("functions", lambda x: F.struct(F.lit("function").alias("kind"), x.alias("item"))),
    )
    return corpus.select("dialect", F.explode(tagged).alias("t")).select("dialect", "t.*").distinct()
