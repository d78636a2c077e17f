"""Small helpers that several operators use."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str | Column) -> Column:
    """The text with NULL as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The array of a text's words, empty for a text without any."""
    return let(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(t != "", F.split(t, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>")),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("bigint")


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL ids count as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def parts_for(amount: int, each: int) -> int:
    """How many parts of about ``each`` hold ``amount``; at least one."""
    return max(1, math.ceil(amount / each))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``limit`` bytes in ``column``, a single row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        begins = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows] if batch.num_rows else []
        for a, b in zip(begins, begins[1:]):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Returns what this Python worker has freed to the system: it stays for later tasks and stages beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, which gives its memory back at the end."""
    yield from batches
    give_back()


def lean_table(table: pa.Table) -> pa.Table:
    """The result of a group, whose other memory is given back."""
    give_back()
    return table


def drop(stored: DataFrame) -> None:
    """Delete a table that ``store`` wrote, once nothing reads it any more."""
    sc = stored.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in stored.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("store-"):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of finished jobs' shuffle files now; Spark deletes them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
