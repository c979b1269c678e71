"""What reaches a shuffle or the driver, whatever the size of the tables."""

import glob
import re
import time

import pytest
from catalogs import catalog
from pyspark.sql import functions as F

from tablecheck.model import Catalog
from tablecheck.operators import align, drift, fleet, graph, integrity, partials, structure
from tablecheck.sources.catalog import write_snapshot
from tablecheck.sources.checkpoints import Scratch


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def sides(spark):
    def side(kind, *lost):
        return catalog(
            spark, tables=[{"table_name": t} for t in ("a", "b", "b")],
            columns=[{"table_name": t, "column_name": n, "data_type": kind, "is_nullable": "NO"} for t in "ab" for n in ("x", "xy", "y") if n not in lost],
            constraints=[{"constraint_name": "k", "table_name": "a", "constraint_type": "p", "definition": "PRIMARY KEY (x)", "columns": ["x"]}],
            indexes=[{"table_name": "a", "index_name": n, "indexdef": f"CREATE INDEX {n} ON a"} for n in ("k", "i")],
        )

    return side("integer"), side("text", "y")


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def test_definitions_are_shuffled_once(sides):
    found = structure.table_ddl(sides[0])
    assert len(exchanges(found)) == 1
    texts = {r.table_name: r.ddl for r in found.collect()}
    assert found.count() == 3 and "ADD CONSTRAINT" in texts["a"] and "CREATE INDEX i" in texts["a"] and "CREATE INDEX k" not in texts["a"]
    assert len(exchanges(structure.matched_objects(*sides))) == 1


def test_columns_are_dealt_by_table_alone(no_broadcast, sides, rows):
    for found in (drift.column_drift(*sides), structure.columns_compared(*sides), align.sync_plan(*sides)):
        assert not [x for x in exchanges(found) if "column_name" in x]
    named = drift.column_drift(*sides).select("type", "object_table", "object_name").distinct()
    different = [("COLUMN_DIFFERENT", t, n) for t in "ab" for n in ("x", "xy")]
    assert rows(named) == sorted([*different, ("COLUMN_MISSING", "a", "y"), ("COLUMN_MISSING", "b", "y")])


def test_rules_without_a_parent_are_not_joined_to_parents(no_broadcast, sides):
    found = integrity.catalog_rules(*sides)
    joined = [x for x in exchanges(found) if x.startswith("parent")]
    assert joined and found.filter("NOT parent_applicable").count() == 3  # b is listed twice
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("required AS kind") == 1  # read again for the sizes of keys before


def test_steps_on_graphs_broadcast_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "parent STRING, child STRING")
    kept = graph.trimmed(edges)
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == [("a", "b"), ("b", "a")]


def test_names_of_files_are_not_shuffled_with_keys(spark):
    data = spark.createDataFrame([("f", 1, 2), ("f", 1, None), ("g", 1, 2)], "file STRING, x INT, y INT").withColumn("changed", F.lit("2020-01-01").cast("timestamp"))
    sets = [partials.KeySet("t", ("x",), ("int",)), partials.KeySet("t", ("x", "y"), ("int", "int"))]
    found = partials.PartialFindings._key_counts(data, sets, data.select("file", "changed").distinct())
    assert "file" not in exchanges(found)[0].split("__file")[-1] and "key_set" not in exchanges(found)[0]
    assert sorted((r.file, r.key_set, r.key, r.complete, r.n) for r in found.collect()) == [
        ("f", "x:int", '{"c0":"1"}', True, 2), ("f", "x:int|y:int", '{"c0":"1","c1":"2"}', True, 1),
        ("f", "x:int|y:int", '{"c0":"1","c1":null}', False, 1), ("g", "x:int", '{"c0":"1"}', True, 1), ("g", "x:int|y:int", '{"c0":"1","c1":"2"}', True, 1),
    ]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_drift_shuffles_columns_and_indexes_of_a_side_once(no_broadcast, sides):
    """Tables, columns and extensions took the source's columns through a shuffle each, and lists of indexes were dealt anew."""
    found = drift.drift(*sides)
    plan = final_plan(found)
    assert len(re.findall(r"ExistingRDD\[table_name#\d+,column_name", plan)) <= 2  # one a side
    assert not [x for x in exchanges(drift.column_drift(*sides)) if "isnull" in x]
    columns = [r for r in found.collect() if r.type.startswith("COLUMN")]
    assert len(columns) == 6


def test_indexes_of_a_union_are_compared_with_one_shuffle_of_the_target(no_broadcast, sides, spark):
    own = sides[0].indexes
    source = Catalog(**{**sides[0].__dict__, "indexes": own.filter("index_name = 'i'").unionByName(own.filter("index_name = 'k'"))})
    target = catalog(spark, indexes=[{"table_name": "a", "index_name": "k", "indexdef": "CREATE INDEX k ON a", "columns": []}])
    found = drift.index_drift(source, target)
    assert len(re.findall(r"hashpartitioning\(of_table#", found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])) == 1
    assert [r.object_name for r in found.collect()] == ["i"]


def test_objects_without_a_table_meet_their_equals(spark):
    index = {"index_name": "i", "indexdef": "x", "columns": ["a", None], "is_unique": True}
    source = catalog(
        spark, tables=[{"table_name": None}], columns=[{"table_name": None, "column_name": "a"}, {"table_name": "", "column_name": "b"}], indexes=[{**index, "table_name": None}],
        constraints=[{"constraint_name": n, "table_name": t, "constraint_type": "p", "definition": "d", "columns": ["a"]} for n, t in (("k", None), ("l", ""))],
    )
    target = catalog(
        spark, tables=[{"table_name": None}], indexes=[{**index, "table_name": ""}],
        constraints=[{"constraint_name": "k", "table_name": None, "constraint_type": "p", "definition": "d", "columns": ["a"]}],
    )
    assert sorted((r.type, r.object_name) for r in drift.drift(source, target).collect() if r.type != "TABLE_MISSING") == [("CONSTRAINT_MISSING_OR_DIFFERENT", "l")]
    assert drift.drift(source, target).filter("type = 'TABLE_MISSING'").count() == 1


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for i in range(len(folders)) for f in glob.glob(f"{folders[i]}/*/shuffle_*.data")}


def test_steps_that_are_written_leave_no_shuffle_files(spark, tmp_path):
    """They stayed beside what was written until the driver collected its garbage."""
    before, df = shuffle_files(spark), spark.range(1000).repartition(3, "id")
    kept = Scratch(spark).keep(df, "t")
    write_snapshot({"schemas": df.selectExpr("string(id) AS schema_name", "'a' AS env")}, str(tmp_path / "s"))
    for _ in range(50):  # removed beside the query
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.count() == 1000, left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_fleet_steps_leave_no_shuffle_files_and_passes_change_nothing(no_broadcast, sides, spark, monkeypatch):
    """Shuffles of all environments and kinds used to be on the disk together."""
    monkeypatch.setattr(fleet, "PASS_BYTES", 1)
    monkeypatch.setattr(fleet, "PASSES", 2)
    before = shuffle_files(spark)
    table = fleet.SignatureTable(spark).add("a", sides[0]).add("b", sides[1])
    found = table.compare("a", ["b"])
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left, left
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found.drop("env")) == rows(drift.drift(*sides)) and found.count() == 6
