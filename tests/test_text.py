import pytest
from pyspark.sql import functions as F

from trilect.functions import sqltext as x


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "dialect, sql, want",
    [
        ("mysql", "SELECT now(), CURRENT_DATE AS current_date", "SELECT '2024-06-15 00:00:00', '2024-06-15' AS current_date"),
        ("mysql", "SELECT CURRENT_DATE(), CURRENT_TIMESTAMP, curtime()", "SELECT '2024-06-15', '2024-06-15 00:00:00', '00:00:00'"),
        ("pg", "SELECT Now(), x AS  Current_Time FROM current_date_log", "SELECT '2024-06-15 00:00:00'::timestamp, x AS  Current_Time FROM current_date_log"),
        ("pg", "localtime localtimestamp", "'00:00:00'::time '2024-06-15 00:00:00'::timestamp"),
        ("postgresql", "CURRENT_DATE", "'2024-06-15'::date"),
        ("oracle", "TRUNC(SYSDATE) < CURRENT_DATE", "TRUNC(TO_TIMESTAMP('2024-06-15 00:00:00', 'YYYY-MM-DD HH24:MI:SS')) < TO_DATE('2024-06-15', 'YYYY-MM-DD')"),
        ("oracle", "NOW()", "NOW()"),
    ],
)
def test_clock_functions(spark, dialect, sql, want):
    assert one(spark, x.pin_time(F.lit(sql), F.lit(dialect))) == want


@pytest.mark.parametrize(
    "dialect, sql, want",
    [
        ("mysql", "RAND( 7 ) + rand() + BRAND()", "(SELECT 0.5) + (SELECT 0.5) + BRAND()"),
        ("pg", "random() + RAND()", "(SELECT 0.5) + RAND()"),
        ("oracle", "DBMS_RANDOM.VALUE(1, 2.5) dbms_random.value DBMS_RANDOM.VALUE() DBMS_RANDOM.RANDOM", "(SELECT 0.5) (SELECT 0.5) (SELECT 0.5) (SELECT 42 FROM DUAL)"),
    ],
)
def test_random_functions(spark, dialect, sql, want):
    assert one(spark, x.pin_random(F.lit(sql), F.lit(dialect))) == want


def test_clean_sql(spark):
    sql = "-- a\n  # b\nSELECT 1 -- keep\n/* x\ny */ FROM t ;; \n"
    assert one(spark, x.clean_sql(F.lit(sql))) == "SELECT 1 -- keep\n FROM t"


def test_clean_sql_drops_closing_semicolons(spark):
    assert one(spark, x.clean_sql(F.lit(" SELECT 1;;; "))) == "SELECT 1"


def test_statements(spark):
    df = spark.createDataFrame([(1, "-- c\nSELECT 1;\n;\n -- d\n; SELECT 2\n-- e\nFROM t")], "id int, sql string")
    got = x.split_statements(df, "sql", ["id"]).orderBy("ordinal").collect()
    assert [r["statement"] for r in got] == ["SELECT 1", "SELECT 2\nFROM t"]


def test_page_text_is_whole_unless_cut(spark):
    html = "<html><script a='b'>x\n<b></script><p>One</p>\n<STYLE>p{}</style><p>two\u00a0 three</p>" + "<i>z</i>" * 5000
    whole = one(spark, x.html_to_text(F.lit(html)))
    assert whole.startswith("One two three z z") and len(whole) == 13 + 2 * 5000
    assert len(one(spark, x.html_to_text(F.lit(html), 6000))) == 6000


@pytest.mark.parametrize(
    "url, length, want",
    [("https://a.org/x", 100, True), ("https://a.org/x", 99, False), ("http://www.Reddit.com/r", 500, False), ("http://fox.com/", 500, False), ("nonsense", 200, True)],
)
def test_kept_pages(spark, url, length, want):
    assert one(spark, x.keep_page(F.lit(url), F.lit("y" * length))) is want


def test_markup(spark):
    assert one(spark, x.strip_markup(F.lit("<b>abcdef</b>"), 4)) == "abcd..."
    assert one(spark, x.strip_markup(F.lit("<b>abcdef</b>"), 4, dots=False)) == "abcd"
    assert one(spark, x.strip_markup(F.lit(None).cast("string"), 4)) == ""


def test_aliases_stay_behind_any_white_space(spark):
    rows = [(k, f"SELECT 1 AS{' ' * k}current_date, CURRENT_DATE AS\n\t  Current_Timestamp") for k in range(1, 41)]
    df = spark.createDataFrame(rows, "k int, sql string")
    for k, got in df.select("k", x.pin_time("sql", F.lit("pg"))).collect():
        assert got == f"SELECT 1 AS{' ' * k}current_date, '2024-06-15'::date AS\n\t  Current_Timestamp"
