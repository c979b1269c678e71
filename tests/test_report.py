import glob

from catalogs import catalog
from pyspark.sql import functions as F

from tablecheck import testkit
from tablecheck.model import DIFF_DDL, IMPACTS, Key, Required, RuleSet, Side, SyncResult, TableRef
from tablecheck.operators import diff
from tablecheck.operators.purge import PurgePlan
from tablecheck.plans import report
from tablecheck.plans.audit import run_audit
from tablecheck.sources.catalog import catalog_from_dataframes


def differences(spark, *items):
    rows = [
        (1, kind, impact, IMPACTS.index(impact) + 1, "t", name, "why", "what", f"DO {name};", "one\ntwo", "") for kind, impact, name in items
    ]
    return spark.createDataFrame(rows, DIFF_DDL)


def text(path):
    return "\n".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_summaries(spark, rows):
    found = differences(spark, ("B", "HIGH", "x"), ("A", "HIGH", "y"), ("A", "LOW", "z"))
    assert rows(report.summary_by_impact(found)) == [(1, "CRITICAL", 0), (2, "HIGH", 2), (3, "MEDIUM", 0), (4, "LOW", 1)]
    assert rows(report.summary_by_type(found)) == [("A", 2), ("B", 1)]


def test_numbers_run_without_gaps_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select(
        (F.col("id") % 4 + 1).cast("int").alias("impact_rank"), F.lit(1).alias("stage"), F.lit("t").alias("object_table"),
        F.format_string("%05d", (F.col("id") * 7919) % 5000).alias("object_name"),
    )
    got = report.numbered(df).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 5001))
    keys = [(r.impact_rank, r.stage, r.object_table, r.object_name) for r in got]
    assert keys == sorted(keys)
    assert report.numbered(df.limit(0)).count() == 0


def test_difference_report_and_scripts(spark, tmp_path):
    found = differences(spark, ("B", "HIGH", "x"), ("A", "CRITICAL", "y"), ("A", "HIGH", "a"))
    report.write_difference_report(found, f"{tmp_path}/report")
    body = text(f"{tmp_path}/report")
    assert "Total differences: 3" in body and "  CRITICAL: 1\n  HIGH: 2\n  MEDIUM: 0\n  LOW: 0" in body
    assert body.index("1. [CRITICAL] A") < body.index("2. [HIGH] A") < body.index("3. [HIGH] B")
    report.write_scripts(found, f"{tmp_path}/scripts")
    script = text(f"{tmp_path}/scripts/all")
    assert script.index("DO y;") < script.index("DO a;") < script.index("DO x;")
    assert "-- Source definition:\n-- one\n-- two\n-- Target definition:\n-- (absent or not available)" in script
    for impact in IMPACTS:
        part = text(f"{tmp_path}/scripts/by_impact/impact={impact}")
        assert part.startswith(report.SCRIPT_HEADER[0])
        assert ("DO " in part) == (impact in ("CRITICAL", "HIGH"))
    high = text(f"{tmp_path}/scripts/by_impact/impact=HIGH")
    assert "-- 1. A" in high and "-- 2. B" in high


def test_empty_reports(spark, tmp_path):
    report.write_difference_report(differences(spark), f"{tmp_path}/report")
    assert "No differences were found." in text(f"{tmp_path}/report")
    report.write_scripts(differences(spark), f"{tmp_path}/scripts")
    assert "No metadata differences" in text(f"{tmp_path}/scripts/all")
    assert text(f"{tmp_path}/scripts/by_impact/impact=LOW").startswith("--")


def test_status(spark):
    row = spark.createDataFrame([(True, False)], "data_compared BOOLEAN, data_equal BOOLEAN")
    got = report.status(row, 1).first()
    assert (got.structure_status, got.data_status, got.overall_status) == ("DIFFERENT", "DIFFERENT", "DIFFERENT")
    row = spark.createDataFrame([(True, True)], "data_compared BOOLEAN, data_equal BOOLEAN")
    assert report.status(row, 0).first().overall_status == "EQUAL"
    row = spark.createDataFrame([(False, False)], "data_compared BOOLEAN, data_equal BOOLEAN")
    assert report.status(row, 0).first().data_status == "NOT COMPARED"


def test_comparison_report(spark, tmp_path):
    columns = [{"table_name": "t", "column_name": "id"}]
    left = Side("left", {"t": spark.range(3)}, catalog(spark, tables=[{"table_name": "t"}], columns=columns))
    right = Side("right", {"t": spark.range(1, 4)}, catalog(spark, tables=[{"table_name": "t"}], columns=columns))
    report.write_comparison_report(diff.compare_table(left, right, "t"), f"{tmp_path}/c")
    body = text(f"{tmp_path}/c")
    for part in ("Direction: left -> right", "Overall: DIFFERENT", "Structure: EQUAL", "Data: DIFFERENT", "Rows only in left: 1",
                 'Sample rows only in left:\n\n{"id":0}', '{"id":3}', 'CREATE TABLE "public"."t"'):
        assert part in body.replace("left:\n{", "left:\n\n{"), part


def test_plan_and_sync_lines(spark, tmp_path):
    cabin, ship = TableRef("sea", "cabin"), TableRef("sea", "ship")
    plan = PurgePlan("target", ship, (cabin, ship), {cabin: 31, ship: 5})
    assert "Rows: 36" in report.plan_lines(plan) and "  1. sea.cabin: 31 row(s)" in report.plan_lines(plan)
    assert "Rows deleted: 36" in report.purge_lines(plan, {cabin: 31, ship: 5})
    lines = report.sync_lines(SyncResult("ship", "a", "b", "DATA", "COMPLETED", 8, 7))
    assert {"Type: DATA", "Direction: a -> b", "Status: COMPLETED", "Statements: 8", "Rows copied: 7"} <= set(lines)
    report.write_text_report(spark, lines, f"{tmp_path}/s")
    assert text(f"{tmp_path}/s").startswith("Table synchronisation\nType: DATA")


def lines(sections):
    return [r.value for r in sections.orderBy("section", "position").collect()]


def test_reports_as_rows_say_what_the_lines_say(spark, tmp_path):
    cabin, ship = TableRef("sea", "cabin"), TableRef("sea", "ship")
    plan = PurgePlan("target", ship, (cabin, ship), {cabin: 31, ship: 5})
    rows = spark.createDataFrame([(0, "sea", "ship", 5, 4), (1, "sea", "cabin", 31, 0)], "depth INT, schema STRING, name STRING, row_count BIGINT, deleted_rows BIGINT")
    assert lines(report.plan_report(rows, "target", ship)) == report.plan_lines(plan)
    assert lines(report.purge_report(rows, "target", ship, "dropped")) == report.purge_lines(plan, {ship: 4}, "dropped")
    assert lines(report.plan_report(rows.limit(0), "target", ship))[4:6] == ["Tables: 0", "Rows: 0"]
    done = SyncResult("ship", "a", "b", "DATA", "COMPLETED", 8, 7, "Done.")
    assert lines(report.sync_report(done.to_df(spark))) == report.sync_lines(done)
    report.write_report(report.sync_report(done.to_df(spark)), f"{tmp_path}/s")
    assert text(f"{tmp_path}/s").startswith("Table synchronisation\nType: DATA")


def test_comparison_report_as_rows(spark):
    columns = [{"table_name": "t", "column_name": "id"}]
    left = Side("left", {"t": spark.range(3)}, catalog(spark, tables=[{"table_name": "t"}], columns=columns))
    right = Side("right", {"t": spark.range(1, 4)}, catalog(spark, tables=[{"table_name": "t"}], columns=columns))
    body = lines(report.comparison_report(diff.compare_table(left, right, "t")))
    assert {"Direction: left -> right", "Overall: DIFFERENT", "Structure: EQUAL", "Data: DIFFERENT", "Rows only in left: 1", "id=0", "id=3"} <= set(body)
    other = Side("right", {"t": spark.range(3).toDF("ID")}, right.catalog)
    body = lines(report.comparison_report(diff.compare_table(left, other, "t")))
    assert "Data: NOT COMPARED" in body and "Not compared: Data was not compared because the columns of left and right differ." in body


def test_audit_end_to_end(spark, tmp_path):
    tables = testkit.load(spark, "/root/testdata/sf0.001", "region", "nation", "customer", "orders")
    rules = testkit.rules().for_tables(tables)
    damaged = {**tables, "orders": testkit.orders_nulls(testkit.orders_parents(tables["orders"]))}
    damaged["customer"] = tables["customer"].filter("c_custkey % 10 <> 0")
    source = Side("source", tables, catalog_from_dataframes(spark, tables, rules))
    fewer = {**damaged, "orders": damaged["orders"].drop("o_totalprice")}
    target = Side("target", fewer, catalog_from_dataframes(spark, fewer, RuleSet(rules.required, rules.keys, ())))
    audit = run_audit(spark, source, target, f"{tmp_path}/out")
    assert audit.ready
    kinds = {r.type: r.n for r in report.summary_by_type(audit.differences).collect()}
    assert kinds == {"COLUMN_MISSING": 1, "CONSTRAINT_MISSING_OR_DIFFERENT": 3}
    found = {(r.type, r.rule_name) for r in audit.findings.collect()}
    assert {("FK_ORPHAN_ROWS", "orders_customer"), ("REQUIRED_NULL_VALUES", "o_orderpriority"), ("REQUIRED_EMPTY_TEXT", "o_orderstatus"),
            ("FK_NULL_RELATION", "orders_customer")} == found
    assert "UPDATE" in text(f"{tmp_path}/out/orphan_fixes")
    assert "Affected rows:" in text(f"{tmp_path}/out/finding_report")


def test_audit_stops_when_a_side_cannot_be_read(spark, tmp_path):
    good = Side("source", {"t": spark.range(1)}, catalog(spark))
    bad = Side("target", {"t": spark.range(1).selectExpr("assert_true(id > 5) AS x", "id")}, catalog(spark))
    audit = run_audit(spark, good, bad, f"{tmp_path}/out", rules=RuleSet((Required("t", "id"),), (Key("k", "t", ("id",)),), ()))
    assert not audit.ready and audit.findings is None
    assert audit.status.filter("state = 'ERROR'").first().side == "target"
