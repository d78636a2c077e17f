"""Scoring of query pairs and the bookkeeping around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from itertools import count, groupby, islice, zip_longest
from threading import Timer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.functions.columns import as_column
from trilect.functions.sqltext import pin_random, pin_time
from trilect.operators.compare import compare_results, tagged_rows
from trilect.operators.relational import top_per_key
from trilect.session import configure

# Outcomes of pairs that the driver holds before it writes them.
STATUS_BATCH = 500
# Pairs whose rows one job writes.
BATCH_PAIRS = 16

# The directions in the order they are tried, and the fallback per source dialect.
DIRECTIONS = [
    ("mysql2pg", "mysql", "pg"),
    ("pg2mysql", "pg", "mysql"),
    ("mysql2oracle", "mysql", "oracle"),
    ("oracle2mysql", "oracle", "mysql"),
    ("pg2oracle", "pg", "oracle"),
    ("oracle2pg", "oracle", "pg"),
]
DEFAULT_DIRECTION = {"mysql": "mysql2pg", "oracle": "oracle2mysql", "pg": "pg2mysql"}
LAST_DIRECTION = "mysql2pg"
DISPLAY = {"mysql": "MySQL", "pg": "PostgreSQL", "oracle": "Oracle"}
TIMEOUT_WORDS = r"(?i:timeout|cancelled|maximum execution time)|ORA-00406"
ERROR_CHARS = 500


def normalize_dialect(dialect: str | Column) -> Column:
    dialect = as_column(dialect)
    return F.when(dialect == "postgresql", F.lit("pg")).otherwise(dialect)


def join_translations(
    source: DataFrame,
    translated: DataFrame,
    seen: str,
    keys: Sequence[str] = ("query_id",),
    per_database: int | None = None,
) -> DataFrame:
    """Source queries with their translation; the last of several by ``seen`` wins.

    Queries without a database are skipped. ``per_database`` keeps the first queries
    of each database.
    """
    last = translated.groupBy(*keys).agg(
        F.max_by(F.coalesce("translated_sql", F.lit("")), seen).alias("translated_sql")
    )
    joined = source.filter(F.coalesce("database", F.lit("")) != "").join(last, list(keys))
    return joined if per_database is None else top_per_key(joined, ["database"], ["query_id"], per_database)


def outcome_status(row_count: str | Column, error: str | Column) -> Column:
    error = F.coalesce(as_column(error), F.lit(""))
    return F.when(error != "", F.lit("error")).when(as_column(row_count) > 0, F.lit("valid")).otherwise(F.lit("empty"))


def outcome_error(error: str | Column) -> Column:
    """The error cut to its first characters, tagged when the query ran out of time."""
    cut = F.left(F.coalesce(as_column(error), F.lit("")), F.lit(ERROR_CHARS))
    return F.when(cut.rlike(TIMEOUT_WORDS), F.concat(F.lit("[TIMEOUT] "), cut)).otherwise(cut)


def infer_direction(source_dialect: str | Column, file_name: str | Column) -> Column:
    """The first direction whose source is part of the dialect and whose target is part of the file's stem."""
    dialect = normalize_dialect(source_dialect)
    base = F.element_at(F.split(F.lower(as_column(file_name)), "/"), -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    choice = F.lit(LAST_DIRECTION)
    for name, direction in DEFAULT_DIRECTION.items():
        choice = F.when(dialect == name, F.lit(direction)).otherwise(choice)
    for direction, source, target in reversed(DIRECTIONS):
        choice = F.when(dialect.contains(source) & stem.contains(target), F.lit(direction)).otherwise(choice)
    return choice


def _display(direction: Column, end: int) -> Column:
    name = F.element_at(F.split(direction, "2"), end)
    shown = name
    for key, label in DISPLAY.items():
        shown = F.when(name == key, F.lit(label)).otherwise(shown)
    return shown


def grade(df: DataFrame) -> DataFrame:
    """Flags and error text per pair.

    Reads direction, translated_sql, source_status, target_status, source_error,
    target_error, match and details. A target error is reported before a source error.
    """
    translated = F.coalesce(F.col("translated_sql"), F.lit("")) != ""
    source_ok = translated & (F.col("source_status") != "error")
    target_ok = translated & (F.col("target_status") != "error")
    target_name, source_name = _display(F.col("direction"), 2), _display(F.col("direction"), 1)
    error = (
        F.when(~translated, F.lit("Empty translated SQL"))
        .when(~target_ok, F.concat(target_name, F.lit(" execution error: "), F.left("target_error", F.lit(ERROR_CHARS))))
        .when(~source_ok, F.concat(source_name, F.lit(" execution error: "), F.left("source_error", F.lit(ERROR_CHARS))))
        .otherwise(F.lit(""))
    )
    reason = (
        F.when(~translated, F.lit(""))
        .when(~target_ok, F.concat(target_name, F.lit(" execution failed: "), F.left("target_error", F.lit(ERROR_CHARS))))
        .when(~source_ok, F.concat(source_name, F.lit(" execution failed: "), F.left("source_error", F.lit(ERROR_CHARS))))
        .otherwise(F.coalesce("details", F.lit("")))
    )
    return df.select(
        *[c for c in df.columns if c not in ("match", "details")],
        F.concat(F.lit("eval_"), F.col("query_id").cast("string")).alias("eval_id"),
        translated.alias("translate_ok"),
        source_ok.alias("source_exec_ok"),
        target_ok.alias("target_exec_ok"),
        (source_ok & target_ok & F.coalesce("match", F.lit(False))).alias("results_match"),
        reason.alias("comparison_details"),
        error.alias("error"),
    )


def percent(part: Column, whole: Column) -> Column:
    """``95.0%`` with one digit, ``0%`` when there is nothing."""
    value = F.bround((part / whole * 100).cast("decimal(20,10)"), 1).cast("decimal(20,1)")
    return F.when(whole > 0, F.concat(value.cast("string"), F.lit("%"))).otherwise(F.lit("0%"))


def score_report(results: DataFrame) -> DataFrame:
    """One row: totals, execution score, execution match and match rate."""
    totals = results.agg(
        F.count(F.lit(1)).alias("total_queries"),
        *[F.count_if(F.col(c)).alias(c) for c in ("translate_ok", "source_exec_ok", "target_exec_ok", "results_match")],
    )
    total = F.nullif(F.col("total_queries"), F.lit(0))
    return totals.select(
        *totals.columns,
        F.coalesce(percent(F.col("target_exec_ok"), total), F.lit("0%")).alias("execution_score"),
        F.coalesce(percent(F.col("results_match"), total), F.lit("0%")).alias("execution_match"),
        F.coalesce(F.col("results_match") / total, F.lit(0.0)).alias("match_rate"),
    )


def score_by(results: DataFrame, dim: str) -> DataFrame:
    """(dim, total, target_ok, match); a missing value counts as ``unknown``."""
    return results.groupBy(F.coalesce(F.col(dim), F.lit("unknown")).alias(dim)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("target_exec_ok").alias("target_ok"),
        F.count_if("results_match").alias("match"),
    )


def failure_sample(results: DataFrame, order: Sequence[Column], n: int = 20) -> DataFrame:
    wanted = ["eval_id", "query_id", "difficulty", "database", "error", "comparison_details"]
    return results.filter(~F.col("results_match")).orderBy(*order).limit(n).select(*wanted)


def evaluate_pairs(
    spark: SparkSession,
    pairs: DataFrame,
    path: str,
    timeout: int = 30,
    workers: int = 8,
    open_database: Callable[[SparkSession, str], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run both queries of every pair (database, query_id, direction, source_sql, translated_sql, ..).

    A pair is known by its database and query_id together. Clocks and random numbers are
    pinned by the dialects of the direction before a query runs. ``open_database`` gets a
    session of its own for each database and puts the database's views there; without it
    all pairs use the views of ``spark``.

    Up to ``BATCH_PAIRS`` pairs of a database run as one job: the union of their rows in one
    write. A batch that fails, or takes longer than ``timeout`` seconds, is halved down
    to the query that is to blame, which alone gets its error; the others keep their results.

    Returns (graded results, one-row report). Results are written under ``path`` by the
    executors and all of them are compared in one job. The driver holds a fixed window of
    batches at a time and writes their outcomes in batches, too.
    """
    sc = spark.sparkContext
    keys = ["database", "query_id"]
    sessions: dict[str, SparkSession] = {}
    numbers = count()
    # All batches that run at a time have two tasks for each core: small queries share a task and a file.
    tasks = max(1, 2 * sc.defaultParallelism // workers)
    sides = {side: F.lit(side).alias("side") for side in ("source", "target")}
    id_type = pairs.schema["query_id"].dataType
    # A number would be part of the generated code, which were compiled anew for every query; a text is not.
    text_ids = isinstance(id_type, T.IntegralType)

    def session(database: str) -> SparkSession:
        if open_database is None:
            return spark
        if database not in sessions:
            while len(sessions) >= 2 * workers:
                sessions.pop(next(iter(sessions)))
            sessions[database] = configure(spark.newSession())
            # Queries that differ in their place in a batch only share their compiled code.
            sessions[database].conf.set("spark.sql.codegen.useIdInClassName", "false")
            open_database(sessions[database], database)
        return sessions[database]

    def write(planned: list[tuple[tuple, DataFrame]]) -> dict[tuple, str]:
        """The error of each query, empty if its rows were written."""
        number = next(numbers)
        tag = f"trilect-{number}"
        sc.addJobTag(tag)
        timer = Timer(timeout, sc.cancelJobsWithTag, [tag])
        timer.start()
        try:
            # a folder of its own: concurrent writers must not share a commit
            rows = _union([rows for _, rows in planned]).coalesce(tasks)
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            return dict.fromkeys([query for query, _ in planned], "")
        except Exception as e:  # whatever the query raised is its outcome
            if len(planned) == 1:
                return {planned[0][0]: (str(e) or type(e).__name__)[:ERROR_CHARS]}
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        middle = len(planned) // 2
        return write(planned[:middle]) | write(planned[middle:])

    def run(own: SparkSession, batch: list) -> list[tuple]:
        planned, errors = [], {}
        database = F.lit(batch[0].database).alias("database")
        for row in batch:
            if text_ids and row.query_id is not None:
                query_id = F.expr(f"'{row.query_id}' AS query_id")
            else:
                query_id = F.lit(row.query_id).cast("string" if text_ids else id_type).alias("query_id")
            for side, sql in (("source", row.source_sql), ("target", row.translated_sql)):
                query = (row.query_id, side)
                try:
                    planned.append((query, tagged_rows(own.sql(sql), database, query_id, sides[side])))
                except Exception as e:
                    errors[query] = (str(e) or type(e).__name__)[:ERROR_CHARS]
        if planned:
            errors |= write(planned)
        return [(r.database, r.query_id, errors[r.query_id, "source"], errors[r.query_id, "target"]) for r in batch]

    dialect = [F.split_part("direction", F.lit("2"), F.lit(k)) for k in (1, 2)]
    pinned = [pin_random(pin_time(c, k), k).alias(c) for c, k in zip(("source_sql", "translated_sql"), dialect)]
    todo = pairs.filter(F.coalesce("translated_sql", F.lit("")) != "").select(*keys, *pinned).orderBy(*keys)
    layout = T.StructType([
        T.StructField("database", T.StringType()), T.StructField("query_id", id_type),
        T.StructField("source_error", T.StringType()), T.StructField("target_error", T.StringType()),
    ])
    written, outcomes = False, []

    def flush() -> None:
        spark.createDataFrame(outcomes, layout).write.mode("append").parquet(f"{path}/status")
        outcomes.clear()

    spark.createDataFrame([], layout).write.mode("overwrite").parquet(f"{path}/status")
    with ThreadPoolExecutor(workers) as pool:
        running: set[Future] = set()
        for batch in _batches(todo.toLocalIterator()):
            running.add(pool.submit(run, session(batch[0].database), batch))
            while len(running) >= 2 * workers:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                outcomes += [o for f in done for o in f.result()]
            if len(outcomes) >= STATUS_BATCH:
                written = written or any(not all(o[2:]) for o in outcomes)
                flush()
        outcomes += [o for f in running for o in f.result()]
    written = written or any(not all(o[2:]) for o in outcomes)
    if outcomes:
        flush()
    fields = "columns array<string>, cells array<struct<s:string,n:double>>, side string, batch bigint"
    ids = T.StructField("query_id", T.StringType() if text_ids else id_type)
    shape = T.StructType([layout.fields[0], ids, *T.DataType.fromDDL(fields).fields])
    rows = spark.read.schema(shape).option("basePath", f"{path}/rows").parquet(f"{path}/rows") if written else spark.createDataFrame([], shape)
    rows = rows.withColumn("query_id", F.col("query_id").cast(id_type)).drop("batch")
    compared = compare_results(rows, pairs.select(*keys), keys)
    joined = pairs.join(spark.read.schema(layout).parquet(f"{path}/status"), keys, "left").join(compared, keys, "left")
    results = grade(
        joined.fillna("", ["source_error", "target_error"])
        .withColumn("source_status", outcome_status("source_rows", "source_error"))
        .withColumn("target_status", outcome_status("target_rows", "target_error"))
    )
    return results, score_report(results)


def _batches(rows: Iterator) -> Iterator[list]:
    """Rows sorted by database as lists of ``BATCH_PAIRS`` at most, each of one database."""
    for _, group in groupby(rows, lambda r: r.database):
        while batch := list(islice(group, BATCH_PAIRS)):
            yield batch


def _union(frames: list[DataFrame]) -> DataFrame:
    """The union as a balanced tree: the plan stays shallow, and each row of it is analysed few times."""
    while len(frames) > 1:
        frames = [a.union(b) if b is not None else a for a, b in zip_longest(frames[::2], frames[1::2])]
    return frames[0]


# --- bookkeeping ----------------------------------------------------------------------


def validation_stats(df: DataFrame) -> DataFrame:
    """Per database: queries by difficulty and status, repairs that worked and that failed.

    ``fixed`` is NULL where no repair was tried.
    """
    return df.groupBy("database").agg(
        F.count(F.lit(1)).alias("total_queries"),
        *[F.count_if(F.col("difficulty") == d).alias(f"n_{d}") for d in ("easy", "medium", "hard", "extra")],
        *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "empty", "error")],
        F.count_if(F.col("fixed")).alias("repaired"),
        F.count_if(~F.col("fixed")).alias("repair_failed"),
    )


def merge_stats(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The newer record of every key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_per_key(both, [key], [F.col("_new").desc()]).drop("_new")


def stats_totals(stats: DataFrame, measures: Sequence[str]) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("total_databases"), *[F.sum(m).alias(f"total_{m}") for m in measures])


def usage_cost(
    input_tokens: Column,
    output_tokens: Column,
    cached_tokens: Column,
    input_price: Column,
    output_price: Column,
    cached_price: Column,
    completions: Column | None = None,
) -> Column:
    """Price of one call, prices per 1000 tokens; cached input counts at its own price if there is one.

    ``completions`` calls share the price evenly.
    """
    split = (cached_tokens > 0) & cached_price.isNotNull()
    cost_in = F.when(
        split, cached_tokens / 1000 * cached_price + (input_tokens - cached_tokens) / 1000 * input_price
    ).otherwise(input_tokens / 1000 * input_price)
    cost = cost_in + output_tokens / 1000 * output_price
    return cost if completions is None else cost / completions


def progress_rollup(df: DataFrame) -> DataFrame:
    """Counts over (verification_passed, db_test_passed, error, total_tokens) records."""
    both = F.col("verification_passed") & F.col("db_test_passed")
    return df.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if("verification_passed").alias("llm_passed"),
        F.count_if("db_test_passed").alias("db_test_passed"),
        F.count_if(both).alias("both_passed"),
        F.count_if(~both).alias("failed"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def pending(databases: DataFrame, outputs: DataFrame, checks: DataFrame) -> DataFrame:
    """Databases to process: all but those with three outputs and both checks passed.

    ``outputs`` holds (db, dialect), ``checks`` (db, verification_passed, db_test_passed).
    """
    complete = outputs.groupBy("db").agg(F.count_distinct("dialect").alias("_n")).filter(F.col("_n") == 3)
    passed = checks.filter(F.col("verification_passed") & F.col("db_test_passed"))
    done = complete.join(passed, "db", "left_semi").select("db")
    return databases.select("db").distinct().join(done, "db", "left_anti")
