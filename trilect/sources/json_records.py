"""The objects of JSON array files, read in splits however long a file is.

Spark's text reader cuts a file at every closing brace, by byte ranges. Whether a piece begins
inside a string, how deep it lies and which object it belongs to are running sums over the
pieces of a file: quotes, brackets, ends of objects. Each sum is taken within the byte ranges
that were read, and over their totals, so that no task holds a file. Files are read once.

Defined cases: an object that never closes takes the rest of its file with it; it and every
element that isn't an object come out as they are, for the caller to reject. One of more than
``RECORD_BYTES`` comes without its text. Empty files and empty arrays give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilect.operators.ordering import checked_broadcast, null_safe_join, offsets_of
from trilect.session import cut, store

#: The longest object, as its text is one cell.
RECORD_BYTES = 64 << 20
#: What a missing last brace makes the counted bytes exceed the file's, without and with a byte order mark.
_OPEN_ENDED = (1, -2)


def _before(pieces: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``pieces`` with, by name, the sum of a weight over all earlier pieces of the file."""
    weighed = pieces.withColumns({f"_of{name}": weight.cast("bigint") for name, weight in sums.items()})
    offsets = offsets_of(weighed, ["file"], {name: F.col(f"_of{name}") for name in sums}).drop("_first")
    met = null_safe_join(weighed, checked_broadcast(offsets), ["_pid", "file"])
    earlier = Window.partitionBy("_pid", "file").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumns({name: F.col(name) + F.coalesce(F.sum(f"_of{name}").over(earlier), F.lit(0)) for name in sums})


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def json_records(spark: SparkSession, path: str, opening: str, level: int) -> DataFrame:
    """(file, offset, record): the objects that lie in ``level`` brackets, with the byte where their part of the file begins.

    ``opening`` is the pattern of what comes before the first. A file that begins with an
    object has it one level higher if ``level`` is 1.
    """
    read = spark.read.option("lineSep", "}").text(path)
    # The reader drops the brace, which belongs to the escape that a piece may end with.
    bare = F.regexp_replace(F.concat("value", F.lit("}")), r"(?s)\\.", "")
    head = F.ltrim(F.translate("value", "\ufeff\t\r\n", ""))
    pieces = read.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_pid"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_mid"),
        (F.octet_length("value") + 1).alias("_bytes"),
        _count(bare, '"').alias("_marks"),
        head.startswith("[").alias("_array"),
    )
    staged = store(pieces)
    counted = _before(staged, {"offset": F.col("_bytes"), "_quotes": F.col("_marks")})

    files = cut(
        staged.groupBy("file").agg(
            F.sum("_bytes").alias("_total"),
            F.max("_size").alias("_size"),
            F.min_by("_array", F.when(F.col("_pid") == 0, F.col("_mid"))).alias("_array"),
        )
    ).select(
        "file",
        F.when((F.col("_total") - F.col("_size")).isin(*_OPEN_ENDED), F.col("_total")).alias("_open"),
        F.when(F.col("_array") | F.lit(level != 1), level).otherwise(level - 1).alias("_level"),
    )
    met = counted.drop("_size").join(checked_broadcast(files), "file")
    ended = ~(F.col("offset") + F.col("_bytes")).eqNullSafe(F.col("_open"))
    met = met.withColumn("_ended", ended).withColumn("_text", F.concat("value", F.when(F.col("_ended"), "}").otherwise("")))
    escaped = F.regexp_replace(F.col("_text"), r"(?s)\\.", "")
    inside = F.when(F.col("_quotes") % 2 == 1, '"').otherwise("")
    outside = F.regexp_replace(F.concat(inside, escaped), r'"[^"]*("|\z)', "")
    # Texts are looked at once; the sums below read numbers only.
    seen = store(
        met.withColumn("_outside", outside).select(
            "file", "_pid", "_mid", "offset", "_bytes", "_text", "_level",
            (_count(F.col("_outside"), "{[") - _count(F.col("_outside"), "}]")).alias("_step"),
            (F.col("_ended") & F.col("_outside").endswith("}")).alias("_brace"),
        )
    )
    deep = _before(seen, {"_depth": F.col("_step")})
    closes = F.col("_brace") & (F.col("_depth") + F.col("_step") == F.col("_level"))
    placed = _before(deep.withColumn("_closes", closes), {"_record": F.when(F.col("_closes"), 1).otherwise(0)})

    placed = store(placed.select("file", "_record", "offset", "_bytes", "_text"))
    sizes = placed.groupBy("file", "_record").agg(F.min("offset").alias("offset"), F.sum("_bytes").alias("_bytes"))
    long = cut(sizes.filter(F.col("_bytes") > RECORD_BYTES))
    short = placed.join(checked_broadcast(long.select("file", "_record")), ["file", "_record"], "left_anti")
    whole = short.groupBy("file", "_record").agg(
        F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("offset", "_text"))).alias("_parts")
    )
    text = F.array_join(F.col("_parts._text"), "")
    text = F.when(F.col("offset") == 0, F.regexp_replace(F.ltrim(text, F.lit("\ufeff")), opening, "")).otherwise(text)
    record = F.regexp_replace(text, r"\A[\s,]+|\s+\z", "")
    found = whole.select("file", "offset", record.alias("record")).filter(~F.col("record").rlike(r"\A[\s\]},]*\z"))
    return found.unionByName(long.select("file", "offset", F.lit(None).cast("string").alias("record")))
