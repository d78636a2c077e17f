"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Settings every job relies on; all can be changed at run time on an open session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Row-level joins on a hot key are split at run time, even where the split
    # costs one more exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Bytes that a task reads of a shuffle, unless the session names its own. Shuffled rows are
# compressed up to twenty-five times here, and a sort holds them unpacked.
TASK_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in TASK_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trilect")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trilect-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For one job: what it puts beside the checkpoints is deleted at the end.

    Results that are read later must be written elsewhere inside the block. One block at a
    time, as the checkpoint folder belongs to the whole session.
    """
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    parent = sc.getCheckpointDir().rpartition("/")[0]
    own = f"{parent}/scratch-{uuid.uuid4().hex}"
    sc.setCheckpointDir(own)
    try:
        yield
    finally:
        sc.setCheckpointDir(parent)
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Row ids and iteration states taken from the result stay the same when an
    executor is lost, because they are read and not computed again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints for ``store``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"


def store(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``cut`` for wide flat rows that are read more than once: a table beside the checkpoints.

    Later passes read only the columns they need. Rows with nested values are
    cheaper to checkpoint as they are. With a ``folder`` the table lies there, whatever its columns.
    """
    if folder is None:
        if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.NullType)) for f in df.schema.fields):
            return cut(df)
        folder = store_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than the session has cores.

    For work that is heavy per row. An input with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for the state of a loop: unions in it must not add partitions round by round."""
    return cut(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
