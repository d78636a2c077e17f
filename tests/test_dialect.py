import datetime

import pytest
from pyspark.sql import functions as F

from trilect.functions import dialect as d


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_division_by_zero_follows_the_dialect(spark):
    a, b = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    assert one(spark, d.divide(a, b, "mysql")) is None
    for name in ("pg", "oracle"):
        with pytest.raises(Exception, match="division by zero"):
            one(spark, d.divide(a, b, name, integers=True))


def test_integer_division(spark):
    a, b = F.lit(5).cast("bigint"), F.lit(2).cast("bigint")
    assert [one(spark, d.divide(a, b, x, integers=True)) for x in d.DIALECTS] == [2.5, 2, 2.5]


def test_greatest_with_null(spark):
    got = [one(spark, d.greatest(F.lit(5), F.lit(None).cast("int"), F.lit(3), dialect=x)) for x in d.DIALECTS]
    assert got == [None, 5, 5]


def test_length_counts_bytes_in_mysql_only(spark):
    assert [one(spark, d.length(F.lit("né€"), x)) for x in d.DIALECTS] == [6, 3, 3]


def test_log(spark):
    assert [round(one(spark, d.log(F.lit(100.0), x)), 4) for x in d.DIALECTS] == [4.6052, 2.0, 4.6052]


@pytest.mark.parametrize(
    "pattern, replacement, mysql, first",
    [
        ("[0-9]", "#", "a##b##", "a#2b34"),
        ("([0-9])([0-9])", r"\2\1", "a21b43", "a21b34"),
        (r"(\d)\d", r"\1-", "a1-b3-", "a1-b34"),
        ("^a|b", "_", "_12_34", "_12b34"),
        ("zz", "_", "a12b34", "a12b34"),
    ],
)
def test_regexp_replace_scope(spark, pattern, replacement, mysql, first):
    s = F.lit("a12b34")
    assert one(spark, d.regexp_replace(s, pattern, replacement, "mysql")) == mysql
    assert one(spark, d.regexp_replace(s, pattern, replacement, "pg")) == first
    assert one(spark, d.regexp_replace(s, pattern, replacement, "pg", flags="g")) == mysql
    assert one(spark, d.regexp_replace(s, pattern, replacement, "oracle")) == first


def test_regexp_replace_first_match_behind_a_line_break(spark):
    assert one(spark, d.regexp_replace(F.lit("x\ny1z2"), "[0-9]", "#", "pg")) == "x\ny#z2"


def test_regexp_replace_backreference_in_pattern(spark):
    assert one(spark, d.regexp_replace(F.lit("abccdd"), r"([a-z])\1", r"<\1>", "pg")) == "ab<c>dd"


def test_truncate_goes_toward_zero(spark):
    values = [one(spark, d.truncate(F.lit(x), 2)) for x in (1.239, -1.239, 0.29, 100.0)]
    assert values == [1.23, -1.23, 0.29, 100.0]


def test_concat_nulls(spark):
    null = F.lit(None).cast("string")
    assert [one(spark, d.concat(F.lit("a"), null, dialect=x)) for x in d.DIALECTS] == [None, None, "a"]
    assert one(spark, d.concat(null, null, dialect="oracle")) is None


def test_date_formats(spark):
    at = F.lit("2024-06-05 15:07:09").cast("timestamp_ntz")
    assert one(spark, d.date_format(at, "%W, %M %d, %Y %h:%i %p", "mysql")) == "Wednesday, June 05, 2024 03:07 PM"
    assert one(spark, d.date_format(at, "Day, Month DD, YYYY HH12:MI AM", "oracle")) == "Wednesday, June 05, 2024 03:07 PM"
    assert one(spark, d.date_format(at, "MONTH-dy HH24:MI:SS", "pg")) == "JUNE-wed 15:07:09"
    assert one(spark, d.date_format(at, "Month|DD", "oracle", blank_padded=True)) == "June     |05"
    assert one(spark, d.date_format(at, "%Y-%m-01 it's %%", "mysql")) == "2024-06-01 it's %"


@pytest.mark.parametrize("text", ["INTERVAL 30 DAY", "INTERVAL '30 days'", "INTERVAL '30' DAY"])
def test_interval_spellings(text):
    assert d.interval_days(text) == 30


def test_whole_years_counts_completed_years(spark):
    def years(a, b):
        return one(spark, d.whole_years(F.lit(a).cast("date"), F.lit(b).cast("date")))

    assert years("2024-06-14", "2020-06-15") == 3
    assert years("2024-06-15", "2020-06-15") == 4
    assert years("2025-02-28", "2024-02-29") == 0


def test_month_shift_keeps_the_day_inside_the_month(spark):
    assert one(spark, d.shift_months(F.lit("2024-03-31").cast("date"), -1)) == datetime.date(2024, 2, 29)


def test_number_format(spark):
    x = F.lit(1234567.5)
    assert one(spark, d.number_format(x, 2, "mysql")) == "1,234,567.50"
    assert one(spark, d.number_format(x, 2, "oracle")) == "1,234,567.50"


def test_json_text_and_its_regex_spelling(spark):
    doc = F.lit('{"primary_skill" : "Go", "k": 7}')
    assert one(spark, d.json_text(doc, "$.primary_skill")) == "Go"
    assert one(spark, d.json_text_by_regex(doc, "primary_skill")) == "Go"
    assert one(spark, d.json_text_by_regex(doc, "k")) == "7"
    assert one(spark, d.json_text_by_regex(doc, "none")) is None


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    first = [df.orderBy(d.order_by("k", x)).first()["k"] for x in d.DIALECTS]
    assert first == [None, 1, 1]
    assert df.orderBy(d.order_by("k", "pg", descending=True)).first()["k"] is None


def test_posix_classes():
    assert d.regex("[[:space:]]*[^[:digit:]]") == r"[\s]*[^0-9]"


def test_hard_numbers(spark):
    t = lambda x, n: one(spark, d.truncate(F.lit(x), n))
    assert [t(1234.5, -2), t(-1234.5, -2), t(-7.89, 1), t(0.123456789012345, 12), t(1e22, 2), t(1.5e20, -19)] == [
        1200.0, -1200.0, -7.8, 0.123456789012, 1e22, 1.5e20,
    ]
    f = lambda x, dialect, n=2: one(spark, d.number_format(F.lit(x), n, dialect))
    assert [f(-5.5, "oracle"), f(-0.5, "pg"), f(0.25, "oracle"), f(-1234567.891, "mysql"), f(-0.5, "mysql")] == [
        "-5.50", "-.50", ".25", "-1,234,567.89", "-0.50",
    ]
    assert f(1e16, "oracle") == "10,000,000,000,000,000.00"
    assert one(spark, d.greatest(F.lit(3), dialect="pg")) == 3


def test_replacement_text(spark):
    r = lambda text, pattern, new, dialect: one(spark, d.regexp_replace(F.lit(text), pattern, new, dialect))
    assert r("a1b2", "[0-9]", "$", "pg") == "a$b2" and r("a1b2", "[0-9]", "$1", "oracle") == "a$1b2"
    assert r("a1", "([0-9])", r"\\\1", "pg") == r"a\1" and r("a1b2", "([0-9])", "<$1>", "mysql") == "a<1>b<2>"


@pytest.mark.parametrize("pattern,dialect", [("%D", "mysql"), ("%Y %u", "mysql"), ("IW", "pg"), ("YYYY-D", "oracle"), ("YYYYT", "pg")])
def test_unknown_format_codes_raise(pattern, dialect):
    with pytest.raises(ValueError, match="unknown format code"):
        d.date_format(F.lit("2024-01-02").cast("date"), pattern, dialect)


def test_literal_letters(spark):
    when = F.lit("2024-01-02").cast("date")
    assert one(spark, d.date_format(when, '"Year" YYYY"-T-"MM', "pg")) == "Year 2024-T-01"
    assert one(spark, d.date_format(when, "%Y%% %m", "mysql")) == "2024% 01"


@pytest.mark.parametrize(
    "value, scale, want",
    [
        (2.499999999, 0, "2"), (2.4999999999999, 0, "2"), (2.5, 0, "3"), (-2.5, 0, "-3"), (0.0004999999999999999, 3, "0.000"), (0.0005, 3, "0.001"),
        (1e21, 0, "1000000000000000000000"), (123456789012345.67, 1, "123456789012345.7"), (1e-30, 2, "0.00"), (None, 2, None),
    ],
)
def test_numbers_are_rounded_once(spark, value, scale, want):
    df = spark.createDataFrame([(value,)], "v double")
    got = df.select(d.to_numeric("v", 38, scale).cast("string").alias("v")).first()["v"]
    assert got == want


def test_whole_numbers_keep_their_digits(spark):
    df = spark.sql("SELECT 1234567890123456789.55BD AS x, 1e21D AS big, -1e300D AS low, '2.499999999999999999' AS t")
    got = df.select(d.to_signed("x"), d.to_signed("big"), d.to_signed("low"), d.to_signed("t"), d.to_numeric("x", 21, 1).cast("string"))
    assert tuple(got.first()) == (1234567890123456790, 2**63 - 1, -(2**63), 2, "1234567890123456789.6")
