import sys

import pytest

import corpus_pipeline
from trilect.llm.queries import ORACLES, QUERIES


def test_stages(spark, documents, data_dir, odd_docs, no_docs):
    for docs in (documents, odd_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, data_dir).collect(), docs.schema)
            assert docs.columns == columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir)
        assert last.count() == docs.count() and all(r.agrees for r in last.collect())


def test_run_is_the_stages_in_a_row(spark, documents, data_dir):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data_dir).collect(), docs.schema)
    wanted = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir).collect()
    got = corpus_pipeline.run(spark, data_dir).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, r.ids) for r in wanted)


def test_run_takes_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """NULLs, clashing columns, repeated rows and no rows at all, through all stages in a row."""
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert all(r.agrees for r in got.collect()) and (name == "odd" or got.count() == 0)


def test_the_first_stage_is_the_ledger(spark, documents, odd_docs, data_dir):
    from trilect.llm.quality_rules import quality_rules

    for docs in (documents, odd_docs):
        kept = sorted(repr((r.doc_id, r.text)) for r in corpus_pipeline.keep_good(spark, docs, data_dir).collect())
        judged = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
        assert {k for k in kept} <= {repr((r.doc_id, r.text)) for r in docs.collect()}
        assert len(kept) == quality_rules(docs).filter("kept").count() and judged


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_the_rest_works_without_the_package():
    import subprocess

    code = (
        "import importlib.util as u, importlib.machinery as m\n"
        "find = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('trilect.llm', 'corpus_pipeline') else find(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_columns(name, spark, data_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, data_dir)
    assert sorted(rel.columns) == sorted(df.columns)
    place = [rel.columns.index(c) for c in df.columns]
    assert sorted((tuple(r[k] for k in place) for r in rel.fetchall()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_ids_that_are_repeated_or_missing_lose_no_text(spark, make_docs, data_dir):
    a, b, c = (" ".join(f"{k}{n}" for n in range(60)) for k in "abc")
    rows = [(5, a), (5, b), (7, b + " more"), (None, c), (None, c), (None, a)]
    kept = corpus_pipeline.drop_near_copies(spark, make_docs(rows), data_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(5, a), (5, b), (None, c)], key=repr)
