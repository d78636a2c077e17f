import random

import pytest
from pyspark.sql import functions as F

from trilect.operators import catalog as c


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_names(left, right):
    lone_left, lone_right = set(left) - set(right), set(right) - set(left)
    out = {}
    for o in lone_left:
        scored = []
        for m in lone_right:
            if m.startswith(o):
                scored.append((-len(o), m))
            elif distance(o, m) <= 2:
                scored.append((-len(o) * 10, m))
        if scored:
            score, match = min(scored)
            out[o] = (match, -score)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_reconcile_like_all_pairs(spark, seed):
    rng = random.Random(seed)

    def names(n):
        return ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(n)]

    left, right = names(40), names(40)
    got = c.reconcile_names(
        spark.createDataFrame([("d", x) for x in left], "db string, name string"),
        spark.createDataFrame([("d", x) for x in right], "db string, name string"),
    ).collect()
    assert {x["name"]: (x["match"], x["score"]) for x in got} == best_names(left, right)


def test_levels_put_parents_first_and_cycles_last(spark):
    tables = [("d", t) for t in "abcdefg"]
    edges = [("d", "b", "a"), ("d", "c", "b"), ("d", "c", "a"), ("d", "d", "d"), ("d", "e", "f"), ("d", "f", "e"), ("d", "g", "e"), ("d", "a", "zz")]
    got = c.fk_levels(
        spark.createDataFrame(tables, "db string, table_name string"),
        spark.createDataFrame(edges, "db string, table_name string, ref_table string"),
    ).collect()
    levels = {x["table_name"]: (x["level"], x["cyclic"]) for x in got}
    assert levels == {
        "a": (0, False), "d": (0, False), "b": (1, False), "c": (2, False), "e": (3, True), "f": (3, True), "g": (3, True),
    }


DDL = """
-- shop; not a table
CREATE TABLE IF NOT EXISTS `authors` (
  `id` INT NOT NULL AUTO_INCREMENT, /* key, (id) */
  `full name` VARCHAR(40) NOT NULL DEFAULT 'a, b',
  `state` ENUM('on','off'),
  boss INT NULL,
  score NUMBER(8,2),
  PRIMARY KEY (`id`),
  UNIQUE KEY `u` (`full name`),
  CONSTRAINT chk CHECK (boss IN ('1', '2')),
  CONSTRAINT `fk` FOREIGN KEY (`boss`) REFERENCES `authors` (`id`) ON DELETE SET NULL
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;
CREATE TABLE "links" ("a" INTEGER, "b" INTEGER, tags TEXT[], at TIMESTAMP WITH TIME ZONE NOT NULL, PRIMARY KEY ("a", "b"),
  FOREIGN KEY ("a", "b") REFERENCES "authors"("id", "x"));
"""


def test_ddl_gives_columns_and_keys(spark):
    ddl = spark.createDataFrame([("shop", "mysql", DDL)], "db string, dialect string, ddl string")
    rows = {(x["table_name"], x["column_name"]): x for x in c.catalog_from_ddl(ddl).collect()}
    assert [k[1] for k in rows if k[0] == "authors"] == ["id", "full name", "state", "boss", "score"]
    ident, name, state = (rows["authors", x] for x in ("id", "full name", "state"))
    assert ident["is_pk"] and ident["is_auto"] and not ident["nullable"] and ident["data_type"] == "INT"
    assert name["max_length"] == 40 and name["is_unique"] and not name["nullable"]
    assert state["allowed_values"] == ["on", "off"] and state["nullable"]
    assert rows["authors", "boss"]["allowed_values"] == ["1", "2"]
    assert rows["authors", "score"]["data_type"] == "NUMBER(8,2)"
    assert rows["links", "tags"]["data_type"] == "TEXT[]" and rows["links", "at"]["data_type"] == "TIMESTAMP WITH TIME ZONE"
    assert rows["links", "a"]["is_pk"] and rows["links", "b"]["is_pk"]
    keys = {(x["table_name"], tuple(x["columns"]), x["ref_table"], tuple(x["ref_columns"])) for x in c.foreign_keys_from_ddl(ddl).collect()}
    assert keys == {("authors", ("boss",), "authors", ("id",)), ("links", ("a", "b"), "authors", ("id", "x"))}


def test_a_table_with_many_columns_is_read_whole(spark):
    columns = ",\n".join(f"`c{i}` DECIMAL(10,2) DEFAULT '0,({i}'" for i in range(3000))
    ddl = spark.createDataFrame([("d", "mysql", f"CREATE TABLE wide ({columns});")], "db string, dialect string, ddl string")
    assert c.catalog_from_ddl(ddl).count() == 3000


@pytest.mark.parametrize(
    "declared, classes",
    [
        ("VARCHAR2(30)", "string"), ("NUMBER", "integer"), ("NUMBER(1)", "integer,boolean"), ("NUMBER(8,2)", "decimal"),
        ("TINYINT(1)", "integer,boolean"), ("TIMESTAMP WITH LOCAL TIME ZONE", "date"), ("jsonb", "json"), ("ENUM('a')", "enum"),
        ("TEXT[]", "array"), ("VARBINARY(16)", "binary"), ("GEOMETRY", ""), ("NUMBER(5,0)", "integer"),
    ],
)
def test_type_classes(spark, declared, classes):
    assert spark.range(1).select(c.classify_type(F.lit(declared)).alias("v")).first()["v"] == classes


def test_short_identifiers_stay_distinct(spark):
    names = spark.range(500).select(F.lit("d").alias("db"), F.concat(F.lit("x" * 40), F.col("id").cast("string")).alias("name"))
    got = c.shorten_identifiers(names, ["db"], "name").collect()
    assert len({x["short_name"].upper() for x in got}) == 500 and all(len(x["short_name"]) == 30 for x in got)


def test_short_names_are_unique_whatever_clashes(spark):
    stem = "customer_order_line_item_extra_"
    names = [stem + str(k) for k in range(20_000)] + [stem.upper() + str(k) for k in range(500)]
    df = spark.createDataFrame([("d", n) for n in names], "db string, name string")
    got = c.shorten_identifiers(df, ["db"], "name").collect()
    assert len(got) == len(names) and len({r.short_name.upper() for r in got}) == len(names)
    assert max(len(r.short_name) for r in got) == 30


def test_passed_numbers_are_counted_by_running_sums_over_sorted_ranges(spark):
    """A hot stem's names and taken numbers lie in several partitions; ties pass nothing."""
    names = [(s, n, False) for s, top in (("hot", 3000), ("b", 4), (None, 3)) for n in range(1, top + 1)]
    taken = [("hot", g, True) for g in range(0, 3000, 7) for _ in range(3)] + [("b", 0, True), ("b", 4, True), (None, 1, True), ("c", 1, True)]
    rows = spark.createDataFrame(names + taken, "_key string, _n bigint, _passed boolean")
    got = {(r["_key"], r["_n"]): r["_before"] for r in c._with_passed(rows, ["_key"]).collect()}
    assert got == {(s, n): sum(t == s and g < n for t, g, _ in taken) for s, n, _ in names}


def test_ddl_with_brackets_of_any_depth(spark):
    deep = "CHECK (" + "(" * 12 + "s = ANY (ARRAY['a'::text, 'b);,('::text])" + ")" * 12 + ")"
    ddl = f"""
        CREATE TABLE IF NOT EXISTS shop."first" (id int PRIMARY KEY, s varchar(10) NOT NULL, -- ); no end
            /* CREATE TABLE x (y int); */ CONSTRAINT k {deep}, price decimal(10, 2));
        CREATE TYPE mood AS ENUM ('sad', 'it''s (ok), fine');
        create unlogged table second (a int, m mood, UNIQUE (a)) ENGINE=InnoDB;
        CREATE TABLE broken id int;
        CREATE TABLE unended (id int
    """
    df = spark.createDataFrame([("d", "pg", ddl), ("e", "pg", None)], "db string, dialect string, ddl string")
    got = [(r.table_name, r.column_name) for r in c.catalog_from_ddl(df).orderBy("table_name", "ordinal").collect()]
    assert got == [("first", "id"), ("first", "s"), ("first", "price"), ("second", "a"), ("second", "m")]
    rejects = [(r.statement, r.part, r.reason) for r in c.ddl_rejects(df).collect()]
    assert rejects == [
        ("CREATE TABLE broken id int", None, "no list of columns"),
        ("CREATE TABLE unended (id int", None, "the end is missing"),
    ]


def test_each_ddl_text_is_read_once_and_on_all_cores(spark):
    ddl = spark.range(40).select(
        F.concat(F.lit("d"), "id").alias("db"), F.lit("pg").alias("dialect"), F.concat(F.lit("CREATE TABLE t (id INT, odd INT SPARSE, k INT UNIQUE REFERENCES t"), "id", F.lit(");")).alias("ddl")
    ).coalesce(1)
    for found, n in ((c.catalog_from_ddl, 120), (c.constraints_from_ddl, 40), (c.foreign_keys_from_ddl, 40), (c.ddl_rejects, 40)):
        df = found(ddl)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and df.count() == n


def test_tokens_keep_gaps_and_unended_comments():
    from trilect.functions.ddl import tokens_of

    got = [(t.kind, t.value, t.spaced) for t in tokens_of("a /* b */ -- c\n 'x''y' \"n\"=1 'open -- end", "pg")]
    assert got == [
        ("word", "a", False), ("text", "'x''y'", True), ("name", '"n"', True), ("mark", "=", False), ("word", "1", False),
        ("mark", "'", True), ("word", "open", False),
    ]
    assert [t.value for t in tokens_of("a /* b ; c", "mysql")] == ["a"] and not list(tokens_of("  -- ; x", "pg"))


def one_table(spark, ddl, dialect="pg"):
    df = spark.createDataFrame([("d", dialect, ddl)], "db string, dialect string, ddl string")
    columns = {r.column_name: r for r in c.catalog_from_ddl(df).collect()}
    keys = [(r.columns, r.ref_schema, r.ref_table, r.ref_columns, r.on_delete, r.on_update) for r in c.foreign_keys_from_ddl(df).collect()]
    texts = [(r.kind, r.columns, r.text) for r in c.constraints_from_ddl(df).collect()]
    return columns, keys, texts, [(r.part, r.reason) for r in c.ddl_rejects(df).collect()]


def test_lists_with_quotes_and_brackets(spark):
    columns, _, texts, rejects = one_table(spark, "CREATE TABLE t (s TEXT, CHECK ((s IN ('it''s','(x)'))), k CHAR(1) CHECK (k IN ('a', 'b')));")
    assert columns["s"].allowed_values == ["it's", "(x)"] and columns["k"].allowed_values == ["a", "b"] and not rejects
    assert texts == [("check", ["s"], "(s IN ('it''s','(x)'))"), ("check", ["k"], "k IN ('a', 'b')")]


def test_keys_in_every_place(spark):
    _, keys, _, rejects = one_table(
        spark,
        "CREATE TABLE x (a BIGINT REFERENCES pub.a(id) ON DELETE CASCADE, b INT REFERENCES y, FOREIGN KEY (a) REFERENCES db.pub.a (id)"
        " MATCH FULL ON UPDATE SET DEFAULT ON DELETE NO ACTION); CREATE TABLE y (n INT, PRIMARY KEY (n));",
    )
    assert not rejects and keys == [
        (["a"], "pub", "a", ["id"], "CASCADE", None), (["b"], None, "y", ["n"], None, None),
        (["a"], "db.pub", "a", ["id"], "NO ACTION", "SET DEFAULT"),
    ]


def test_words_inside_texts_are_no_options(spark):
    columns, _, texts, rejects = one_table(
        spark,
        "CREATE TABLE t (code VARCHAR(4) DEFAULT 'UNIQUE', note TEXT DEFAULT 'PRIMARY KEY' NOT NULL, at TIMESTAMP DEFAULT now() - interval '1 day',"
        ' n NUMBER(8,2) GENERATED BY DEFAULT AS IDENTITY, m INT GENERATED ALWAYS AS (n * 2) STORED, "key" INT, key VARCHAR(3), x DOUBLE PRECISION);',
    )
    assert not rejects and list(columns) == ["code", "note", "at", "n", "m", "key", "x"]
    assert not any(r.is_unique or r.is_pk for r in columns.values())
    assert not columns["note"].nullable and columns["n"].is_auto and not columns["m"].is_auto and columns["x"].data_type == "DOUBLE PRECISION"
    assert [t for k, _, t in texts if k == "default"] == ["'UNIQUE'", "'PRIMARY KEY'", "now() - interval '1 day'"]


def test_backslashes_escape_in_one_dialect(spark):
    mysql = one_table(spark, r"""CREATE TABLE t (`a` ENUM('it\'s', "b") COMMENT 'x\', y', KEY `k` (`a`(3)), KEY (`a` DESC)) ENGINE=InnoDB;""", "mysql")
    assert mysql[0]["a"].allowed_values == ["it's", "b"] and not mysql[3]
    pg = one_table(spark, r"CREATE TABLE t (a TEXT DEFAULT 'C:\', b INT);")
    assert list(pg[0]) == ["a", "b"] and pg[2] == [("default", ["a"], r"'C:\'")]


def test_what_is_not_read_is_told(spark):
    columns, _, _, rejects = one_table(
        spark, "CREATE TABLE t (a INT SPARSE, LIKE other, b, FOREIGN KEY (a), CONSTRAINT c, d INT); CREATE TABLE u (a INT"
    )
    assert {"a", "d"} <= set(columns)  # of a column with an unknown option the rest is told
    assert {p or r for p, r in rejects} >= {"a INT SPARSE", "b", "FOREIGN KEY (a)", "CONSTRAINT c", "the end is missing"}
    assert one_table(spark, "")[0] == {} and one_table(spark, ";;'")[3] == []


def test_the_reader_travels_with_the_job():
    """An executor without the package can load what a job sends it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from trilect.functions.ddl import read_ddl

    sent = cloudpickle.dumps(read_ddl).hex()
    code = f"import pickle, sys; f = pickle.loads(bytes.fromhex('{sent}')); print(f('CREATE TABLE t (a INT);', 'pg')['tables'][0]['table_name'], 'trilect' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/")
    assert out.stdout.split() == ["t", "False"], out.stderr


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_names_of_small_databases_meet_without_keys(spark, monkeypatch, most):
    monkeypatch.setattr(c, "PAIRS", most)
    keyed = []
    monkeypatch.setattr(c, "_edit_keys", lambda df, name, make=c._edit_keys: keyed.append(name) or make(df, name))
    rng = random.Random(5)
    sides = [["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(40)] + ["", "é1", "日本x"][k:] for k in range(2)]
    rows = [spark.createDataFrame([("d", x) for x in names] + [(None, "abc"), ("d", None)], "db string, name string") for names in sides]
    got = {x["name"]: (x["match"], x["score"]) for x in c.reconcile_names(*rows).collect()}
    expected = best_names(*sides)
    expected.pop("", None)  # nothing begins with an empty name or is close to it
    assert got == expected
    assert bool(keyed) == (most == 0)
