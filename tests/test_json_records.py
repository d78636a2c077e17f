import json
import random

import pytest

from trilect.sources import tables as io
from trilect.sources.json_records import json_records

NASTY = ['a"b', "c\\", "}{][,", '\\"}', "é😀 ", "line\nbreak", "", " }", '\\\\"', '{"query_id": 5}']


def made(rng, n):
    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return [rng.choice(NASTY) + rng.choice(NASTY), rng.randrange(99), None][kind]
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(NASTY) + str(k): value(depth - 1) for k in range(rng.randrange(3))}

    return [{"query_id": str(k), "sql": rng.choice(NASTY) + rng.choice(NASTY), "x": value(3)} for k in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_arrays_over_many_splits(small_splits, tmp_path):
    rng, wanted = random.Random(3), []
    for name, style in [("a", {}), ("b", {"indent": 3}), ("c", {"ensure_ascii": False, "separators": (",", ":")})]:
        rows = made(rng, 250)
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, **style) + rng.choice(["", "\n"]), encoding="utf-8")
        wanted += [(f"{name}.json", r) for r in rows]
    for name, text in [("empty", ""), ("none", "[]"), ("blank", " [ \n] ")]:
        (tmp_path / f"{name}.json").write_text(text)
    assert small_splits.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = json_records(small_splits, str(tmp_path), r"\A\s*\[", 1).collect()
    key = lambda p: (p[0], json.dumps(p[1], sort_keys=True))
    assert sorted([(r.file.rpartition("/")[2], json.loads(r.record)) for r in got], key=key) == sorted(wanted, key=key)
    for r in got:
        text = (tmp_path / r.file.rpartition("/")[2]).read_bytes()[r.offset :].decode()
        assert r.record in text and text.index(r.record) < 20


def test_rejects_name_file_and_offset(spark, tmp_path):
    good, bad = '{"query_id": 1, "sql": "}"}', '{"query_id": tru}'
    (tmp_path / "a.json").write_text(f'[{good}, {bad}, {{"sql": "x"}}, 7, {good.replace("1", "2", 1)}')
    (tmp_path / "b.json").write_text('[{"query_id": 3}, {"query_id": 4')
    (tmp_path / "c.json").write_text('{"query_id": 9, "sql": "one"}')
    (tmp_path / "d.json").write_text("not json at all")
    assert [r.query_id for r in io.read_query_corpus(spark, str(tmp_path)).collect()] == ["9"]
    assert sorted(r.query_id for r in io.read_query_corpus(spark, str(tmp_path), salvage=True).collect()) == ["1", "3", "9"]
    rejects = {(r.file.rpartition("/")[2], r.offset, r.reason, r.record) for r in io.query_corpus_rejects(spark, str(tmp_path)).collect()}
    first = len(good) + 1
    assert rejects == {
        ("a.json", first, "not json", bad),
        ("a.json", first + 2 + len(bad), "no id", '{"sql":"x"}'),
        ("a.json", first + 2 + len(bad) + 2 + 12, "not json", '7, {"query_id": 2, "sql": "}"}'),
        ("b.json", 16, "not json", '{"query_id": 4'),
        ("d.json", 0, "not json", "not json at all"),
    }


def test_differences_over_many_splits(small_splits, tmp_path):
    rng = random.Random(5)
    entries = [{"id": f"D{rng.randrange(150)}", "feature": f"{rng.choice(NASTY)}{k}", "test_requirements": {"query_patterns": [rng.choice(NASTY)]}} for k in range(400)]
    (tmp_path / "a.json").write_text(json.dumps({"version": {"n": [1, "x"]}, "differences": entries + [{"feature": "none"}]}, indent=1))
    (tmp_path / "b.json").write_text('{"differences": []}')
    got = {r.id: (r.feature, r.test_requirements.query_patterns) for r in io.read_differences(small_splits, str(tmp_path)).collect()}
    assert got == {e["id"]: (e["feature"], e["test_requirements"]["query_patterns"]) for e in entries}
    rejects = io.difference_rejects(small_splits, str(tmp_path)).collect()
    assert [(r.file.rpartition("/")[2], r.reason, r.record) for r in rejects] == [("a.json", "no id", '{"feature":"none"}')]


def test_array_files_are_read_and_parsed_once(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps([{"query_id": "1", "sql": "}"}, {"query_id": "2", "sql": "["}]))
    kept = io.read_query_corpus(spark, str(tmp_path))
    (tmp_path / "a.json").unlink()
    assert sorted((r.query_id, r.sql) for r in kept.collect()) == [("1", "}"), ("2", "[")]
    kept.explain(True)
    assert "from_json" not in capsys.readouterr().out
