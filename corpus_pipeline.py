"""The corpus pipeline: from raw documents to token ids.

Each stage takes all that its predecessor kept, and its decisions take effect: rejected
documents and near copies go, repeated passages leave their texts, and the mix takes a
document never, once or twice. Near copies share 80 % or more of their 5-word shingles.
Inputs may have NULLs in any column, repeated rows and other columns; the stages' own
modules define what becomes of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from trilect.llm import mixing, ngram_join, pieces, quality_rules, suffix_dedup
from trilect.llm.queries import tokenizer
from trilect.session import configure, ensure_checkpoint_dir

# Texts go to the Python workers so many bytes at a time: a batch is held by the executor and by
# its worker at once, for every core.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """The session's settings hold for a stage wherever it is run from."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_component(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs, tokenizer())


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet beside the checkpoints and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
