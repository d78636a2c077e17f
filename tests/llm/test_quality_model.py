import pytest
from pyspark.sql import functions as F

from trilect.llm import quality_model as qm
from trilect.llm.quality_rules import measurements  # noqa: F401


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = qm.score_quality(docs, labels).cache()
    assert scored.count() == docs.count()
    assert scored.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    met = scored.filter("held_out").join(labels, "doc_id")
    right = met.filter("predicted = quality").count()
    assert right >= 0.97 * met.count()
    worse = met.filter("quality = 0").agg(F.max("score")).first()[0]
    better = met.filter("quality = 1").agg(F.min("score")).first()[0]
    assert worse < better


def test_held_out_labels_teach_nothing(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).cache()
    turned = labels.withColumn("quality", F.when(qm.crc_remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(qm.score_quality(docs, labels).collect()) == sorted(qm.score_quality(docs, turned).collect())


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int, score double")
    one_kind = spark.createDataFrame([(4, 1, 0, 0.1), (6, 1, None, 0.1), (9, None, 0, 0.1), (None, 0, 0, 0.1)], none.schema)
    for labels, least in ((none, 0.49), (one_kind, 0.6)):
        scored = qm.score_quality(odd_docs, labels).collect()
        assert len(scored) == odd_docs.count() and all(least < r.score < 0.99 for r in scored)
    assert qm.score_quality(no_docs, one_kind).count() == 0


def test_paths_of_a_printed_tree():
    text = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= 1.5)
   If (feature 2 <= -2.0E-4)
    Predict: 0.0
   Else (feature 2 > -2.0E-4)
    Predict: 1.0
  Else (feature 0 > 1.5)
   Predict: 1.0
"""
    a, b = ("log_words", True, 1.5), ("symbols", True, -2.0e-4)
    assert qm.paths(text) == [(a,), (a, b), (a, ("symbols", False, -2.0e-4)), (("log_words", False, 1.5),)]


def test_rules_compile_to_columns(spark):
    ensemble = qm.RuleEnsemble(0.0, (((("upper", True, 0.5), ("digits", False, 0.1)), 2.0), ((("upper", False, 0.5),), -1.0)))
    df = spark.createDataFrame([(0.2, 0.3), (0.2, 0.0), (0.9, 0.0)], "upper double, digits double")
    got = [r[0] for r in df.select(ensemble.score()).collect()]
    assert got == pytest.approx([0.880797, 0.5, 0.268941], abs=1e-6)
    assert "Python" not in df.select(ensemble.score())._jdf.queryExecution().executedPlan().toString()
