import pytest
from catalogs import catalog

from tablecheck.model import ForeignKey
from tablecheck.operators import align
from tablecheck.sources.store import TableStore

SELF = ForeignKey("emp_boss", "emp", ("boss",), "emp", ("id",))
CHILD = ForeignKey("c_p", "c", ("p_id",), "p", ("id",))


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_align_schema(spark, rows):
    df = spark.createDataFrame([("1", None, 7), ("2", "x", 8)], "id STRING, name STRING, extra INT")
    out = align.align_schema(df, [("name", "string", False), ("id", "int", False), ("added", "double", True), ("flag", "string", False)],
                             {"name": "'none'", "flag": "upper('y')"})
    assert out.dtypes == [("name", "string"), ("id", "int"), ("added", "double"), ("flag", "string"), ("extra", "int")]
    assert rows(out) == [("none", 1, None, "Y", 7), ("x", 2, None, "Y", 8)]


def test_sync_plan(spark):
    def k(name, kind, text):
        return {"table_name": "t", "constraint_name": name, "constraint_type": kind, "definition": text}

    def i(name, text):
        return {"table_name": "t", "index_name": name, "indexdef": text}

    source = catalog(
        spark, schema="src", tables=[{"table_name": "t"}, {"table_name": "new"}],
        columns=[
            {"table_name": "t", "column_name": "a", "ordinal_position": 1, "data_type": "text", "comment": "it's"},
            {"table_name": "t", "column_name": "b", "ordinal_position": 2, "is_nullable": "NO", "column_default": "0"},
            {"table_name": "new", "column_name": "x"},
        ],
        constraints=[k("pk", "p", "PRIMARY KEY (a)"), k("ck", "c", "CHECK (a)"), k("same", "c", "CHECK (b)"), k("diff", "c", "CHECK (c)"), k("nn", "n", "NOT NULL b")],
        indexes=[i("i1", 'CREATE INDEX i1 ON "src"."t" (a)'), i("i2", 'CREATE INDEX i2 ON "src"."t" (b)'), i("pk", "CREATE UNIQUE INDEX pk")],
    )
    target = catalog(
        spark, schema="dst", tables=[{"table_name": "t"}],
        columns=[{"table_name": "t", "column_name": "a"}, {"table_name": "t", "column_name": "kept"}],
        constraints=[k("other", "c", "CHECK(B)"), k("diff", "c", "CHECK (d)")],
        indexes=[i("i2", "CREATE INDEX i2 ON x"), i("pk", "CREATE UNIQUE INDEX pk")],
    )
    made = align.sync_plan(source, target).persist()
    plan = sorted(made.collect())
    assert [(r.table_name, r.seq, r.action, r.object_name) for r in plan] == [
        ("new", 1, "CREATE_TABLE", "new"),
        ("t", 1, "ALTER_COLUMN", "a"),
        ("t", 2, "ADD_COLUMN", "b"),
        ("t", 3, "ADD_CONSTRAINT", "ck"),
        ("t", 4, "REPLACE_CONSTRAINT", "diff"),
        ("t", 5, "PROMOTE_INDEX", "pk"),
        ("t", 6, "CREATE_INDEX", "i1"),
        ("t", 7, "REPLACE_INDEX", "i2"),
    ]
    text = {r.object_name: r.sql for r in plan}
    assert text["new"] == 'CREATE TABLE "dst"."new" (\n    "x" INTEGER\n);'
    assert text["b"] == 'ALTER TABLE "dst"."t" ADD COLUMN "b" INTEGER DEFAULT 0 NOT NULL;'
    assert text["a"].endswith("COMMENT ON COLUMN \"dst\".\"t\".\"a\" IS 'it''s';")
    assert text["pk"] == 'ALTER TABLE "dst"."t" ADD CONSTRAINT "pk" PRIMARY KEY USING INDEX "pk";'
    assert text["i1"] == 'CREATE INDEX i1 ON "dst"."t" (a);'
    assert text["i2"].startswith('DROP INDEX "dst"."i2";\n')
    assert align.sync_plan(source, source).isEmpty()


def test_sync_schema(spark, store):
    store.publish({"t": spark.createDataFrame([("1", 5)], "id STRING, kept INT")})
    source = spark.createDataFrame([(1, "x")], "id INT, name STRING")
    plan = spark.createDataFrame([("t", 1, "ALTER_COLUMN"), ("t", 2, "ADD_COLUMN"), ("t", 3, "ADD_CONSTRAINT")], "table_name STRING, seq INT, action STRING")
    only = align.sync_schema(plan.filter("seq = 3"), source, store, "t")
    assert (only.status, only.statements) == ("UNCHANGED", 0) and "1 statement(s)" in only.detail
    assert align.sync_schema(plan.limit(0), source, store, "t").status == "UNCHANGED"
    assert store.read("t").columns == ["id", "kept"]
    done = align.sync_schema(plan, source, store, "t", required=["name"], defaults={"name": "'n'"})
    assert (done.status, done.statements, done.sync_type) == ("COMPLETED", 2, "SCHEMA")
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "n", 5)]


def test_replace_data(spark, store):
    store.publish({"t": spark.range(3)})
    done = align.replace_data(spark.range(10, 15), store, "t")
    assert (done.status, done.rows_copied, done.statements) == ("COMPLETED", 5, 6)
    assert ids(store.read("t")) == [10, 11, 12, 13, 14]
    assert done.to_df(spark).first().sync_type == "DATA"
    with pytest.raises(ValueError, match="align the schema"):
        align.replace_data(spark.range(1).toDF("other"), store, "t")


def test_parent_gate_blocks(spark, store):
    store.publish({"p": spark.range(2), "c": spark.createDataFrame([(1, 1)], "id INT, p_id INT")})
    incoming = spark.createDataFrame([(1, 0), (2, 5), (3, 5), (4, None)], "id INT, p_id INT")
    with pytest.raises(ValueError, match=r"c_p: 1 reference\(s\) do not exist in target.p"):
        align.replace_data(incoming, store, "c", [CHILD])
    assert ids(store.read("c")) == [1]
    missing = align.parent_gate(incoming, {}, "c", [CHILD]).first()
    assert missing.missing_keys is None and "parent table p is missing" in missing.message


def test_self_reference_looks_at_the_incoming_rows(spark, store):
    store.publish({"emp": spark.createDataFrame([(9, None)], "id INT, boss INT")})
    incoming = spark.createDataFrame([(1, None), (2, 1)], "id INT, boss INT")
    assert align.replace_data(incoming, store, "emp", [SELF]).rows_copied == 2
    with pytest.raises(ValueError, match="emp_boss"):
        align.replace_data(spark.createDataFrame([(3, 2)], "id INT, boss INT"), store, "emp", [SELF])


def test_replacing_a_parent_keeps_its_children_whole(spark, store):
    store.publish({"p": spark.range(3), "c": spark.createDataFrame([(1, 2), (2, 2)], "id INT, p_id INT")})
    with pytest.raises(ValueError, match=r"c_p: 2 row\(s\) of c would lose their parent"):
        align.replace_data(spark.range(2), store, "p", [CHILD])
    assert align.replace_data(spark.range(2, 4), store, "p", [CHILD]).rows_copied == 2


def test_store_shows_all_tables_at_once(spark, store):
    store.publish({"a": spark.range(1), "b": spark.range(2)})
    before = store.manifest()
    bad = spark.range(5).selectExpr("assert_true(id < 3) AS x", "id")
    with pytest.raises(Exception):
        store.publish({"a": spark.range(9), "b": bad})
    assert store.manifest() == before and store.read("a").count() == 1
    store.publish({}, drop=["a"])
    assert store.tables() == ["b"]
    other = TableStore(spark, store.root)
    with pytest.raises(RuntimeError, match="Another publish"):
        other._commit({}, 2)
