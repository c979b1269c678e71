import pytest
from catalogs import catalog

from tablecheck.model import Catalog
from tablecheck.operators import drift
from tablecheck.sources import catalog as builders
from tablecheck.sources import tables


def test_engine_and_jdbc_options():
    assert tables.engine_of("jdbc:postgresql://h:1/d") == "postgresql"
    assert tables.engine_of("mssql://h") == tables.engine_of("jdbc:sqlserver://h;databaseName=d") == "sqlserver"
    with pytest.raises(ValueError):
        tables.engine_of("jdbc:oracle:thin")
    options = tables.jdbc_options("u", "t", user="me", partition_column="id", bounds=(0, 9), partitions=4)
    assert options["numPartitions"] == "4" and options["fetchsize"] == "10000" and "password" not in options
    assert "numPartitions" not in tables.jdbc_options("u", "t")


def test_load_counts_and_status(spark, tmp_path, rows):
    path = str(tmp_path / "t.parquet")
    spark.range(7).write.parquet(path)
    spark.range(2).createOrReplaceTempView("a_view")
    side = tables.load_side(spark, "source", {"t": path, "v": "a_view", "d": spark.range(1)})
    assert rows(tables.table_counts(side.tables)) == [("d", 1), ("t", 7), ("v", 2)]
    assert tables.scan(side.tables["t"], ["id"]).columns == ["id"]
    good = tables.source_status(spark, "source", {"t": path})
    bad = tables.source_status(spark, "target", {"t": path, "gone": str(tmp_path / "gone.parquet"), "no_table": "no_table"})
    assert tables.all_ready(good) and not tables.all_ready(good, bad)
    assert {(r.table_name, r.state) for r in bad.collect()} == {("t", "OK"), ("gone", "ERROR"), ("no_table", "ERROR")}
    assert all(r.error for r in bad.filter("state = 'ERROR'").collect())


def test_names(spark, rows):
    c = catalog(spark, tables=[{"table_name": n} for n in ("One", "two", "TWO", "three", "Three")])
    wanted = spark.createDataFrame([("one",), ("two",), ("Two",), ("four",), ("three",)], "requested STRING")
    assert rows(tables.resolve_tables(c, wanted)) == [
        ("Two", None, "AMBIGUOUS"), ("four", None, "MISSING"), ("one", "One", "OK"), ("three", "three", "OK"), ("two", "two", "OK"),
    ]
    assert tables.resolve_name(c, " ONE ", "source") == "One"
    for name, message in (("Two", "exact spelling"), ("four", "source has no table"), ("  ", "No table name")):
        with pytest.raises(ValueError, match=message):
            tables.resolve_name(c, name, "source")


def test_key_columns_keep_the_order_of_the_key(spark):
    frames = {
        "namespace": ([("a", 1, "public"), ("a", 2, "other")], "env STRING, oid BIGINT, nspname STRING"),
        "class": (
            [("a", 10, "t", 1), ("a", 11, "p", 2), ("a", 12, "elsewhere", 2)],
            "env STRING, oid BIGINT, relname STRING, relnamespace BIGINT",
        ),
        "attribute": (
            [("a", 10, 1, "x"), ("a", 10, 2, "y"), ("a", 10, 3, "z"), ("a", 11, 1, "k"), ("a", 11, 2, "l")],
            "env STRING, attrelid BIGINT, attnum INT, attname STRING",
        ),
        "constraint": (
            [
                ("a", 1, "fk", 10, "f", "d", False, False, "a", "c", 11, [3, 1], [2, 1]),
                ("a", 2, "none", 10, "c", "d", True, True, " ", " ", 0, [], None),
                ("a", 3, "out", 12, "p", "d", False, False, " ", " ", 0, [1], None),
            ],
            "env STRING, oid BIGINT, conname STRING, conrelid BIGINT, contype STRING, definition STRING, condeferrable BOOLEAN, "
            "condeferred BOOLEAN, confupdtype STRING, confdeltype STRING, confrelid BIGINT, conkey ARRAY<INT>, confkey ARRAY<INT>",
        ),
    }
    raw = {n: spark.createDataFrame(v, ddl) for n, (v, ddl) in frames.items()}
    got = {r.constraint_name: r for r in builders.build_constraints(raw, "public").collect()}
    assert set(got) == {"fk", "none"}
    assert (got["fk"].columns, got["fk"].referenced_columns) == (["z", "x"], ["l", "k"])
    assert (got["fk"].referenced_table, got["fk"].referenced_schema) == ("p", "other")
    assert (got["none"].columns, got["none"].referenced_columns, got["none"].referenced_table) == ([], [], None)


def test_snapshot_round_trip(spark, tmp_path):
    root = str(tmp_path / "snapshot")
    made = catalog(spark, tables=[{"table_name": "t"}], columns=[{"table_name": "t", "column_name": "a"}])
    kinds = ("schemas", "tables", "columns", "constraints", "indexes", "views", "matviews", "sequences", "functions", "extensions", "triggers")
    both = {}
    for kind in kinds:
        df = getattr(made, kind)
        both[kind] = df.selectExpr("'left' AS env", "*").unionByName(df.selectExpr("'right' AS env", "*"))
    builders.write_snapshot(both, root)
    left, right = (builders.read_snapshot(spark, root, env) for env in ("left", "right"))
    assert isinstance(left, Catalog) and left.columns.count() == 1
    assert drift.drift(left, right).isEmpty()
    plan = left.columns._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "env" in plan


def test_raw_queries_cover_what_the_builders_read(spark):
    from queries.inputs import RAW

    assert set(RAW) == set(builders.RAW_QUERIES)


def test_splits_hold_like_shares_of_crowded_keys(spark):
    from tablecheck.sources.tables import split_predicates

    rows = spark.range(20000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 7 <> 0 THEN id * id END AS k", "id", "CAST('2020-01-01' AS DATE) + CAST(id % 400 AS INT) AS day")
    for columns, splits in ((["k", "id"], 10), (["day"], 8), (["id"], 5)):
        conditions = split_predicates(rows, columns, splits, "mysql")
        sizes = [rows.filter(c).count() for c in conditions]
        assert sum(sizes) == 20000 and rows.filter(" AND ".join(f"NOT coalesce({c}, false)" for c in conditions)).isEmpty()
        assert len(conditions) >= splits and max(sizes) <= 2 * 20000 / len(conditions)
    assert split_predicates(rows.limit(0), ["id"], 4) == ['("id" IS NOT NULL)']
    assert split_predicates(spark.range(2).selectExpr("id AS `a\"b`"), ["a\"b"], 2)[0] == '("a""b" < 0)'
