"""Table and record readers, report and query-file writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.operators.ordering import checked_broadcast
from trilect.session import cut, store
from trilect.sources.json_records import json_records

# Record layouts, stated so that no read ever infers a schema.
SOURCE_QUERY = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("dialect", T.StringType()),
    ]
)
TRANSLATED_QUERY = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("translated_sql", T.StringType()),
        T.StructField("database", T.StringType()),
    ]
)
_TEXTS = T.ArrayType(T.StringType())
DIFFERENCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField(
            "test_requirements",
            T.StructType(
                [
                    T.StructField("query_requirements", _TEXTS),
                    T.StructField("query_patterns", _TEXTS),
                    T.StructField("data_requirements", _TEXTS),
                    T.StructField("schema_requirements", _TEXTS),
                ]
            ),
        ),
    ]
)
REQUIREMENT_KINDS = [
    "query_requirements",
    "query_patterns",
    "data_requirements",
    "schema_requirements",
]


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A live table read in ``partitions`` key ranges instead of through one connection."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, **options)
        .options(lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
        .load()
    )


_CORRUPT = "_corrupt_record"


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of (file, offset, record) rows, with the text of what isn't an object of JSON."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    read = F.from_json("record", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    parsed = records.withColumn("_read", F.when(F.col("record").startswith("{"), read))
    broken = F.when(F.col("_read").isNull(), F.coalesce("record", F.lit(""))).otherwise(F.col(f"_read.{_CORRUPT}"))
    return parsed.select(*[F.col(f"_read.{f}").alias(f) for f in schema.fieldNames()], broken.alias(_CORRUPT), "file", "offset")


def _records(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    """Records with the text of those that can't be read, their file and, of arrays, their offset."""
    if not lines:
        return _parsed(json_records(spark, path, r"\A\s*\[", 1), schema)
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    return read.json(path).select("*", F.col("_metadata.file_path").alias("file"), F.lit(None).cast("bigint").alias("offset"))


def _rejects(records: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    whole = F.to_json(F.struct(*schema.fieldNames()))
    reason = F.when(F.col(_CORRUPT).isNotNull(), F.lit("not json")).when(F.col(key).isNull(), F.lit("no id"))
    rows = records.select("file", "offset", reason.alias("reason"), F.coalesce(_CORRUPT, whole).alias("record"))
    return rows.filter("reason is not null")


def _kept(records: DataFrame, key: str, salvage: bool) -> DataFrame:
    """Sound records with an id; without ``salvage``, those of files that are sound throughout."""
    if not salvage:
        records = store(records)  # parsed once for the broken files and for the rest
    sound = records.filter(F.col(_CORRUPT).isNull() & F.col(key).isNotNull())
    if salvage:
        return sound
    broken = cut(records.filter(F.col(_CORRUPT).isNotNull()).select("file").distinct())
    return sound.join(checked_broadcast(broken), "file", "left_anti")


def read_query_corpus(
    spark: SparkSession, path: str, schema: T.StructType = SOURCE_QUERY, lines: bool = False, salvage: bool = False
) -> DataFrame:
    """Query records, from JSON arrays or, with ``lines``, one record a line; ids are kept as text.

    Both are read in splits. An array file with a broken part is refused whole, unless
    ``salvage`` asks for its sound records. What isn't JSON is in ``query_corpus_rejects``.
    """
    return _kept(_records(spark, path, schema, lines), "query_id", salvage or lines).select(*schema.fieldNames())


def query_corpus_rejects(spark: SparkSession, path: str, schema: T.StructType = SOURCE_QUERY, lines: bool = False) -> DataFrame:
    """(file, offset, reason, record): records that aren't JSON and records without an id.

    The offset is where the record's part of an array file begins, NULL with ``lines``.
    """
    return _rejects(_records(spark, path, schema, lines), schema, "query_id")


def _difference_records(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(json_records(spark, path, r'(?s)\A.*?"differences"\s*:\s*\[', 2), DIFFERENCE)


def read_differences(spark: SparkSession, path: str, salvage: bool = False) -> DataFrame:
    """``{"differences": [...]}`` files as one row per difference; the last entry of an id wins.

    A file with a broken part is refused whole, unless ``salvage`` asks for its sound entries.
    What isn't JSON is in ``difference_rejects``.
    """
    kept = _kept(_difference_records(spark, path), "id", salvage)
    entry = F.struct(*DIFFERENCE.fieldNames())
    last = kept.groupBy("id").agg(F.max_by(entry, F.struct("file", "offset")).alias("d"))
    return last.select("d.*")


def difference_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, reason, record): entries that aren't JSON and entries without an id."""
    return _rejects(_difference_records(spark, path), DIFFERENCE, "id")


def explode_requirements(differences: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., id, feature, category, kind, ordinal, requirement), one row per listed requirement."""
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(f"test_requirements.{kind}").alias("items"))
            for kind in REQUIREMENT_KINDS
        ]
    )
    return (
        differences.select(*keep, "id", "feature", "category", F.explode(kinds).alias("k"))
        .select(*keep, "id", "feature", "category", "k.kind", F.posexplode("k.items").alias("ordinal", "requirement"))
    )


def write_report(report: DataFrame, results: DataFrame, path: str) -> None:
    """The one-row summary and the per-query rows, each in its own folder."""
    report.write.mode("overwrite").json(f"{path}/report")
    results.write.mode("overwrite").json(f"{path}/results")


def write_partitioned_queries(queries: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per database and dialect; a large folder is split over files, not forced into one."""
    (
        queries.write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("database", "dialect")
        .json(path)
    )


def write_sql_dump(script: DataFrame, path: str) -> None:
    """A script from ``operators.export.database_script``: its range-ordered lines as text parts.

    Concatenating the part files in name order gives the runnable script.
    """
    ordered = script.repartitionByRange("level", "table_name", "section", "batch_no").sortWithinPartitions(
        "level", "table_name", "section", "batch_no"
    )
    ordered.select("line").write.mode("overwrite").text(path)

