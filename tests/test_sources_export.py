import glob
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.functions import literals as lit
from trilect.operators import export, score
from trilect.sources import tables as io


def test_query_corpus(spark, tmp_path):
    source = [{"query_id": 1, "difficulty": "easy", "sql": "SELECT 1", "database": "d", "dialect": "mysql"}, {"query_id": 2, "sql": "x"}]
    (tmp_path / "q.json").write_text(json.dumps(source, indent=2))
    rows = io.read_query_corpus(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()
    assert [(r["query_id"], r["dialect"]) for r in rows] == [("1", "mysql"), ("2", None)]
    (tmp_path / "t.json").write_text(json.dumps([{"query_id": 1, "translated_sql": "SELECT 2"}]))
    assert io.read_query_corpus(spark, str(tmp_path / "t.json"), io.TRANSLATED_QUERY).first()["translated_sql"] == "SELECT 2"


def test_differences(spark, tmp_path):
    entries = [
        {"id": "D1", "feature": "F", "category": "c", "test_requirements": {"query_requirements": ["old"]}},
        {"id": "D1", "feature": "F", "category": "c", "test_requirements": {"query_requirements": ["a", "b"], "query_patterns": ["p"]}},
    ]
    (tmp_path / "d.json").write_text(json.dumps({"differences": entries}))
    exploded = io.explode_requirements(io.read_differences(spark, str(tmp_path / "d.json"))).collect()
    assert sorted((r["kind"], r["ordinal"], r["requirement"]) for r in exploded) == [
        ("query_patterns", 0, "p"), ("query_requirements", 0, "a"), ("query_requirements", 1, "b"),
    ]


def test_reports_and_query_files(spark, tmp_path):
    results = spark.createDataFrame([(1, True, True, True, True)], "query_id int, translate_ok boolean, source_exec_ok boolean, target_exec_ok boolean, results_match boolean")
    io.write_report(score.score_report(results), results, str(tmp_path / "r"))
    report = spark.read.json(str(tmp_path / "r/report")).first()
    assert report["execution_match"] == "100.0%" and spark.read.json(str(tmp_path / "r/results")).count() == 1
    queries = spark.createDataFrame([("a", "mysql", 1), ("a", "pg", 2), ("b", "pg", 3)], "database string, dialect string, id int")
    io.write_partitioned_queries(queries, str(tmp_path / "q"))
    assert len(glob.glob(str(tmp_path / "q/database=*/dialect=*"))) == 3


def test_empty_report(spark):
    empty = spark.createDataFrame([], "translate_ok boolean, source_exec_ok boolean, target_exec_ok boolean, results_match boolean")
    row = score.score_report(empty).first()
    assert (row["total_queries"], row["execution_score"], row["match_rate"]) == (0, "0%", 0.0)


@pytest.mark.parametrize("dialect", ["mysql", "pg", "oracle"])
def test_script_is_written_in_order(spark, tmp_path, dialect):
    parents = spark.range(120).select(F.col("id").alias("k"), F.format_string("it's %d", "id").alias("name"))
    children = spark.range(3).select(F.col("id").alias("c"), F.col("id").alias("k"))
    script = export.database_script(
        {"child": children, "parent": parents, "none": parents.limit(0)}, {"parent": 0, "child": 1, "none": 0},
        {"child": ["c"], "parent": ["k"], "none": ["k"]}, dialect, auto_increment={"parent": "k"}, title="shop",
    )
    io.write_sql_dump(script, str(tmp_path / dialect))
    text = "\n".join(open(p).read().rstrip("\n") for p in sorted(glob.glob(str(tmp_path / dialect / "part-*"))) if open(p).read())
    assert text.startswith(f"-- shop ({dialect})")
    assert text.index("-- parent: 120 rows") < text.index("-- child: 3 rows") and "none" not in text
    assert text.count("INSERT INTO") == (123 if dialect == "oracle" else 4)
    assert text.index("(0, ") < text.index("(50, ") < text.index("(119, ")
    assert ("it\\'s 7" if dialect == "mysql" else "it''s 7") in text
    if dialect == "pg":
        assert "SELECT setval(pg_get_serial_sequence('parent', 'k'), 119, true);" in text
    if dialect == "oracle":
        assert text.endswith("COMMIT;")


@pytest.mark.parametrize(
    "value, declared, mysql, pg, oracle",
    [
        ("0x4142", "BLOB", "0x4142", "E'\\\\x4142'", "HEXTORAW('4142')"),
        ("raw", "BYTEA", "UNHEX('raw')", "'raw'", "UTL_RAW.CAST_TO_RAW('raw')"),
        ('{"a": "b\'c"}', "JSON", "'{\\\"a\\\": \\\"b\\'c\\\"}'", "'{\"a\": \"b''c\"}'::jsonb", "'{\"a\": \"b''c\"}'"),
        ('["x", "y\'z"]', "TEXT[]", "'[\\\"x\\\", \\\"y\\'z\\\"]'", "ARRAY['x', 'y''z']::TEXT[]", "'[\"x\", \"y''z\"]'"),
        ("[]", "TEXT[]", "'[]'", "ARRAY[]::TEXT[]", "'[]'"),
        ("2024-01-15T08:30:00+08:00", "DATE", "'2024-01-15 08:30:00'", "'2024-01-15 08:30:00'", "TO_DATE('2024-01-15 08:30:00', 'YYYY-MM-DD HH24:MI:SS')"),
        ("2024-01-15", "DATE", "'2024-01-15'", "'2024-01-15'", "TO_DATE('2024-01-15', 'YYYY-MM-DD')"),
        ("2024-01-15T08:30:00.5Z", "TIMESTAMP WITH TIME ZONE", "'2024-01-15 08:30:00'", "'2024-01-15 08:30:00'",
         "TO_TIMESTAMP_TZ('2024-01-15T08:30:00+00:00', 'YYYY-MM-DD\"T\"HH24:MI:SSTZH:TZM')"),
        ("08:30:00", "TIME", "'08:30:00'", "'08:30:00'", "'08:30:00'"),
        ("true", "TINYINT(1)", "1", "TRUE", "1"),
        (" 12 ", "NUMBER(10)", "12", "12", "12"),
        ("a\\b\t", "VARCHAR(9)", "'a\\\\b\\t'", "'a\\b\t'", "'a\\b\t'"),
    ],
)
def test_typed_literals(spark, value, declared, mysql, pg, oracle):
    df = spark.createDataFrame([(value,)], "v string")
    got = df.select(*[lit.sql_literal("v", T.StringType(), d, declared).alias(d) for d in ("mysql", "pg", "oracle")]).first()
    assert tuple(got) == (mysql, pg, oracle)


@pytest.mark.parametrize(
    "value, want", [(1.0, "1"), (1.5, "1.5"), (1e14, "100000000000000"), (float("nan"), "NULL"), (float("inf"), "NULL"), (0.1234567, "0.123457"), (None, "NULL"), (-2.0, "-2")]
)
def test_double_literals(spark, value, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(lit.sql_literal("v", T.DoubleType(), "pg").alias("v")).first()["v"] == want


def test_numbers_in_boolean_columns(spark):
    df = spark.createDataFrame([(1,), (0,)], "v int")
    got = [r["v"] for r in df.select(lit.sql_literal("v", T.IntegerType(), "pg", "BOOLEAN").alias("v")).collect()]
    assert got == ["TRUE", "FALSE"]


def test_pairs_are_run_and_graded(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("ten")
    cases = [
        (1, "SELECT id FROM ten", "SELECT id FROM ten ORDER BY id DESC"),
        (2, "SELECT id FROM ten", "SELECT id FROM missing"),
        (3, "SELECT 1/0 AS x FROM ten", "SELECT 1 AS x"),
        (4, "SELECT id FROM ten WHERE id > 99", "SELECT id FROM ten WHERE id < 0"),
        (5, "SELECT id FROM ten", ""),
        (6, "SELECT id FROM ten", "SELECT id + 1 AS id FROM ten"),
    ]
    pairs = spark.createDataFrame(
        [(q, "mysql2pg", "easy", "d", a, b) for q, a, b in cases],
        "query_id bigint, direction string, difficulty string, database string, source_sql string, translated_sql string",
    )
    results, report = score.evaluate_pairs(spark, pairs, str(tmp_path / "pairs"), workers=4)
    got = {r["query_id"]: r for r in results.collect()}
    assert [got[q]["results_match"] for q in range(1, 7)] == [True, False, False, True, False, False]
    assert got[2]["error"].startswith("PostgreSQL execution error: ") and got[3]["error"].startswith("MySQL execution error: ")
    assert got[5]["error"] == "Empty translated SQL" and got[6]["comparison_details"].startswith("Value mismatch")
    row = report.first()
    assert (row["total_queries"], row["target_exec_ok"], row["results_match"]) == (6, 4, 2)
    assert row["execution_score"] == "66.7%"


def test_a_failing_or_late_query_does_not_take_its_batch_along(spark, tmp_path):
    """40 pairs run in a few jobs; one query fails while it runs, one never ends."""
    spark.range(10).createOrReplaceTempView("ten")
    sql = {
        7: "SELECT 10 / (id - id) AS x FROM ten",
        21: "SELECT count(*) AS n FROM range(3000000) a JOIN range(3000000) b ON a.id % 7 <= b.id",
    }
    pairs = spark.createDataFrame(
        [(q, "mysql2pg", "easy", f"d{q // 20}", f"SELECT {q} AS v, id FROM ten", sql.get(q, f"SELECT id, {q} AS v FROM ten")) for q in range(40)],
        "query_id bigint, direction string, difficulty string, database string, source_sql string, translated_sql string",
    )
    folder = tmp_path / "pairs"
    results, _ = score.evaluate_pairs(spark, pairs, str(folder), timeout=5, workers=2)
    got = {r["query_id"]: r for r in results.collect()}
    assert [q for q in got if not got[q]["results_match"]] and {q for q in got if not got[q]["results_match"]} == {7, 21}
    assert got[7]["source_exec_ok"] and got[21]["source_exec_ok"] and not got[7]["target_exec_ok"] and not got[21]["target_exec_ok"]
    written = [f for f in (folder / "rows").iterdir() if any(f.glob("*.parquet"))]
    assert len(written) < 20  # two queries a pair would be 80


def test_queries_of_a_batch_share_tasks_and_files(spark, tmp_path):
    """Small results go into few files, and names and ids of any kind come through as they are."""
    spark.range(10).createOrReplaceTempView("ten")
    odd = "it's \\ ${x} d"
    cases = [(q, f"SELECT id AS `{odd}`, {q} AS v FROM ten", f"SELECT {q} AS v, id AS `{odd}` FROM ten") for q in range(15)]
    cases += [(-(10**18), "SELECT CAST('2024-01-01' AS DATE) AS d, true AS b", "SELECT '2024-01-01' AS d, 1 AS b")]
    pairs = spark.createDataFrame(
        [(q, "mysql2pg", "easy", odd, a, b) for q, a, b in [*cases, (None, "SELECT 1 AS x", "SELECT 1 AS x")]],
        "query_id bigint, direction string, difficulty string, database string, source_sql string, translated_sql string",
    )
    results, _ = score.evaluate_pairs(spark, pairs, str(tmp_path / "pairs"), workers=2 * spark.sparkContext.defaultParallelism)
    got = {r["query_id"]: (r["database"], r["target_exec_ok"], r["results_match"]) for r in results.collect()}
    assert all(got[q] == (odd, True, True) for q, _, _ in cases) and len(got) == 17
    batches = [len(list(f.glob("*.parquet"))) for f in (tmp_path / "pairs" / "rows").iterdir() if f.is_dir()]
    assert sorted(batches) == [1, 1]  # one file for each query would be 32 and 2


def test_records_that_can_not_be_used_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"query_id": "oracle_extra_3", "sql": "SELECT 1"}, {"query_id": 7}, {"sql": "SELECT 2"}]')
    (tmp_path / "b.json").write_text('[{"query_id": 8}, {broken]')
    kept = io.read_query_corpus(spark, str(tmp_path)).collect()
    assert sorted(r.query_id for r in kept) == ["7", "oracle_extra_3"]
    rejects = {(r.file.rpartition("/")[2], r.reason) for r in io.query_corpus_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {("a.json", "no id"), ("b.json", "not json")}
