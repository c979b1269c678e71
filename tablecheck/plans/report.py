"""Summaries over differences and findings, and the files they are written to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions.ddl import comment_lines, text_or_empty
from tablecheck.functions.text import strip_text
from tablecheck.functions.unions import balanced_union
from tablecheck.model import IMPACTS, SyncResult, TableRef
from tablecheck.operators.diff import TableComparison, sort_columns
from tablecheck.operators.drift import _text
from tablecheck.operators.purge import PurgePlan
from tablecheck.sources.checkpoints import Scratch

DIFF_ORDER = ("impact_rank", "stage", "object_table", "object_name")
FINDING_ORDER = ("impact_rank", "stage", "table_name", "rule_name")


def summary_by_impact(results: DataFrame) -> DataFrame:
    """Count per impact, all four levels present, most severe first in ``impact_rank``."""
    counts = results.groupBy("impact").agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("impact_rank"), F.lit(v).alias("impact"))
                                 for i, v in enumerate(IMPACTS, 1)]))
    every = results.sparkSession.range(1).select(levels.alias("l")).select("l.*")
    return every.join(counts, "impact", "left").select(
        "impact_rank", "impact", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def summary_by_type(results: DataFrame) -> DataFrame:
    return results.groupBy("type").agg(F.count("*").alias("n"))


def numbered(results: DataFrame, order: Sequence[str] = DIFF_ORDER) -> DataFrame:
    """Add ``number``, running from 1 in the given order, without passing all rows through one task.

    The sorted rows are written once to the shared folder, each with its partition and its place in it. A row's number is
    its place plus the rows of the partitions before its own.
    """
    spark = results.sparkSession
    placed = results.orderBy(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = Scratch(spark).keep(placed, "numbered")
    part = F.shiftright("__place", 33)
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the sort.
    sizes = placed.groupBy(part.alias("part")).count().collect()
    offset, starts = 0, []
    for row in sorted(sizes, key=lambda r: r.part):
        starts.append((row.part, offset))
        offset += row["count"]
    starts = spark.createDataFrame(starts, "part BIGINT, start BIGINT")
    joined = placed.join(F.broadcast(starts), part == F.col("part"))
    return joined.select((F.col("start") + within + 1).alias("number"), *[f"`{c}`" for c in results.columns])


def status(summary: DataFrame, structure_differences: Column | int) -> DataFrame:
    """Add ``structure_status``, ``data_status`` and ``overall_status`` to a comparison summary."""
    n = structure_differences if isinstance(structure_differences, Column) else F.lit(structure_differences)
    same = n == 0
    return (
        summary.withColumn("structure_status", F.when(same, "EQUAL").otherwise("DIFFERENT"))
        .withColumn(
            "data_status",
            F.when(~F.col("data_compared"), "NOT COMPARED").when(F.col("data_equal"), "EQUAL").otherwise("DIFFERENT"),
        )
        .withColumn(
            "overall_status",
            F.when(same & F.col("data_compared") & F.col("data_equal"), "EQUAL").otherwise("DIFFERENT"),
        )
    )


def _or(text: Column, absent: str) -> Column:
    return F.when(text_or_empty(text) == "", absent).otherwise(text)


def difference_text(number: Column) -> Column:
    """One difference as a block of a report."""
    c = F.col
    return _text(
        number.cast("string"), ". [", c("impact"), "] ", c("type"), "\n   ", c("description"), "\n   Reason: ",
        c("impact_reason"), "\n   Source definition:\n   ", _or(c("source_definition"), "(not available)"),
        "\n   Target definition:\n   ", _or(c("target_definition"), "(absent or not available)"),
        "\n   Suggested script:\n   ", _or(F.trim("sql"), "(no automatic script)"), "\n",
    )


def finding_text(number: Column) -> Column:
    c = F.col
    fix = F.when(text_or_empty(c("fix_sql")) != "", _text("\n   Proposed repair:\n   ", c("fix_sql"))).otherwise("")
    return _text(
        number.cast("string"), ". [", c("impact"), "] ", c("type"), "\n   ", c("description"), "\n   Affected rows: ",
        c("count").cast("string"), "\n   Reason: ", c("impact_reason"), "\n   Review query:\n   ", c("review_sql"), fix, "\n",
    )


def script_block(number: Column) -> Column:
    """One difference as a commented block of a script, the statement last."""
    c = F.col
    return _text(
        "-- ", number.cast("string"), ". ", c("type"), "\n-- Impact: ", c("impact"), "\n-- Reason: ", c("impact_reason"),
        "\n-- ", c("description"), "\n-- Source definition:\n", comment_lines(c("source_definition")),
        "\n-- Target definition:\n", comment_lines(c("target_definition")), "\n-- Suggested change:\n",
        F.expr(strip_text("sql", ends="right")), "\n",
    )


def fix_block(number: Column) -> Column:
    c = F.col
    return _text(
        "-- ", number.cast("string"), ". ", c("type"), "\n-- Impact: ", c("impact"), "\n-- Affected rows: ",
        c("count").cast("string"), "\n-- ", c("description"), "\n", _or(c("fix_sql"), "-- No automatic fix."), "\n",
    )


SCRIPT_HEADER = (
    "-- One numbered block for each difference between two catalogs.",
    "-- Blocks do not depend on each other; a CAUTION line marks those that lose data.",
    "-- Nothing here has been run.",
    "",
)


def _lines(df: DataFrame, header: Sequence[str], text: Column, empty: str) -> DataFrame:
    """``position, value``: header lines at or below 0, then one row per result."""
    spark = df.sparkSession
    top = spark.createDataFrame([(i - len(header), v) for i, v in enumerate(header)], "position BIGINT, value STRING")
    body = df.select(F.col("number").alias("position"), text.alias("value"))
    out = top.unionByName(body)
    return out.unionByName(spark.createDataFrame([(0, empty)], "position BIGINT, value STRING")) if empty else out


def write_lines(df: DataFrame, path: str) -> None:
    """Text files whose order by name is the order of the rows: each covers one range of positions."""
    df.orderBy("position").select("value").write.mode("overwrite").text(path)


def _write_report(
    results: DataFrame, numbers: DataFrame, title: str, unit: str, nothing: str, text: Column, path: str
) -> None:
    impacts = {r.impact: r.n for r in summary_by_impact(results).collect()}
    types = sorted((r.type, r.n) for r in summary_by_type(results).collect())
    total = sum(impacts.values())
    header = [title, "", f"Total {unit}: {total}", ""]
    if total:
        header += ["By impact:", *[f"  {level}: {impacts[level]}" for level in IMPACTS], "", "By type:"]
        header += [f"  {kind}: {n}" for kind, n in types] + ["", "Detail:", ""]
    write_lines(_lines(numbers, header, text, "" if total else nothing), path)


def write_difference_report(results: DataFrame, path: str, numbers: DataFrame | None = None) -> None:
    numbers = numbered(results) if numbers is None else numbers
    _write_report(
        results, numbers, "Metadata comparison: source to target", "differences", "No differences were found.",
        difference_text(F.col("number")), path,
    )


def write_finding_report(results: DataFrame, path: str, numbers: DataFrame | None = None) -> None:
    numbers = numbered(results, FINDING_ORDER) if numbers is None else numbers
    _write_report(
        results, numbers, "Data integrity of the target under the source's rules", "findings",
        "No integrity problems were found.", finding_text(F.col("number")), path,
    )


def script_rows(numbers: DataFrame) -> DataFrame:
    """``impact, position, value``: blocks of the per-impact scripts, each impact with a header even when empty."""
    spark = numbers.sparkSession
    header = "\n".join(SCRIPT_HEADER)
    heads = spark.createDataFrame([(level, 0, header) for level in IMPACTS], "impact STRING, position BIGINT, value STRING")
    # Numbers restart per impact: subtract what comes before the level.
    firsts = numbers.groupBy("impact").agg(F.min("number").alias("__first"))
    body = numbers.join(F.broadcast(firsts), "impact")
    local = F.col("number") - F.col("__first") + 1
    body = body.select("impact", local.alias("position"), script_block(local).alias("value"))
    return heads.unionByName(body)


def write_scripts(results: DataFrame, root: str, numbers: DataFrame | None = None) -> None:
    """``root/all`` with every difference, and ``root/by_impact/impact=LEVEL`` per level."""
    numbers = numbered(results) if numbers is None else numbers
    nothing = "" if not numbers.isEmpty() else "-- No metadata differences were found."
    write_lines(_lines(numbers, SCRIPT_HEADER, script_block(F.col("number")), nothing), f"{root}/all")
    rows = script_rows(numbers).repartitionByRange("impact", "position").sortWithinPartitions("impact", "position")
    rows.select("impact", "value").write.mode("overwrite").partitionBy("impact").text(f"{root}/by_impact")


def write_orphan_fixes(findings: DataFrame, path: str) -> None:
    orphans = numbered(findings.filter("type = 'FK_ORPHAN_ROWS'"), FINDING_ORDER)
    header = ["-- Proposed repair of orphaned rows: review before running it.",
              "-- An UPDATE is proposed only where the foreign key accepts NULL.", ""]
    nothing = "" if not orphans.isEmpty() else "-- No orphaned rows were found."
    write_lines(_lines(orphans, header, fix_block(F.col("number")), nothing), path)


def sync_lines(result: SyncResult) -> list[str]:
    return [
        "Table synchronisation", f"Type: {result.sync_type}", f"Table: {result.table_name}",
        f"Direction: {result.source_name} -> {result.target_name}", f"Status: {result.status}", "",
        f"Statements: {result.statements}", f"Rows copied: {result.rows_copied}", f"Detail: {result.detail}",
    ]


def plan_lines(plan: PurgePlan, action: str = "emptied") -> list[str]:
    listed = [
        f"  {i}. {t.schema}.{t.name}: {plan.row_counts[t]} row(s)" for i, t in enumerate(plan.order, 1)
    ]
    return [
        f"Tables to be {action}", f"Side: {plan.side}", f"Table asked for: {plan.target.schema}.{plan.target.name}", "",
        f"Tables: {len(plan.order)}", f"Rows: {plan.total_rows}", "", "Order:", *listed, "",
        "All tables change in one publish; if anything fails nothing changes.",
    ]


def purge_lines(plan: PurgePlan, deleted: Mapping, action: str = "emptied") -> list[str]:
    listed = [
        f"  {i}. {t.schema}.{t.name}: {deleted.get(t, 0)} row(s) deleted" for i, t in enumerate(plan.order, 1)
    ]
    return [
        f"Tables {action}", "Status: COMPLETED", f"Side: {plan.side}",
        f"Table asked for: {plan.target.schema}.{plan.target.name}", "", f"Tables: {len(plan.order)}",
        f"Rows deleted: {sum(deleted.values())}", "", "Detail:", *listed,
    ]


def _sections(rows: DataFrame, section: int, lines: Sequence[Column]) -> DataFrame:
    """``section, position, value``: every row of a small frame as some lines; NULL lines are left out."""
    found = rows.select(F.posexplode(F.array(*[F.struct(line.alias("value")) for line in lines])).alias("position", "line"))
    found = found.select(F.lit(section).alias("section"), F.col("position").cast("bigint").alias("position"), F.col("line.value").alias("value"))
    return found.filter("value IS NOT NULL")


def _amount(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("0"))


def sync_report(results: DataFrame) -> DataFrame:
    """``section, position, value``: the report of synchronisations, from the rows of ``SyncResult.to_df``."""
    c = F.col
    return _sections(results, 1, [
        _text("Table synchronisation"), _text("Type: ", c("sync_type")), _text("Table: ", c("table_name")),
        _text("Direction: ", c("source_name"), " -> ", c("target_name")), _text("Status: ", c("status")), _text(""),
        _text("Statements: ", _amount("statements_executed")), _text("Rows copied: ", _amount("rows_copied")), _text("Detail: ", c("detail")),
    ])


def plan_report(rows: DataFrame, side: str, target: TableRef, action: str = "emptied") -> DataFrame:
    """``section, position, value``: the report of a purge or drop that is planned, from the rows of ``purge.plan_rows``."""
    total = rows.agg(F.count("*").alias("n"), F.sum("row_count").alias("r"))
    head = _sections(total, 1, [
        _text(f"Tables to be {action}"), _text(f"Side: {side}"), _text(f"Table asked for: {target.schema}.{target.name}"), _text(""),
        _text("Tables: ", _amount("n")), _text("Rows: ", _amount("r")), _text(""), _text("Order:"),
    ])
    end = _sections(total, 3, [_text(""), _text("All tables change in one publish; if anything fails nothing changes.")])
    return head.unionAll(_listed(rows, "row_count", " row(s)")).unionAll(end)


def purge_report(rows: DataFrame, side: str, target: TableRef, action: str = "emptied") -> DataFrame:
    """``section, position, value``: the report of a purge or drop that is done, from ``depth, schema, name, deleted_rows``."""
    head = _sections(rows.agg(F.count("*").alias("n"), F.sum("deleted_rows").alias("r")), 1, [
        _text(f"Tables {action}"), _text("Status: COMPLETED"), _text(f"Side: {side}"), _text(f"Table asked for: {target.schema}.{target.name}"), _text(""),
        _text("Tables: ", _amount("n")), _text("Rows deleted: ", _amount("r")), _text(""), _text("Detail:"),
    ])
    return head.unionAll(_listed(rows, "deleted_rows", " row(s) deleted"))


def _listed(rows: DataFrame, amount: str, unit: str) -> DataFrame:
    """The tables of a closure, children first: a row per table, numbered in one task."""
    number = F.row_number().over(Window.orderBy(F.desc("depth"), "schema", "name"))
    line = _text("  ", number.cast("string"), ". ", F.col("schema"), ".", F.col("name"), ": ", _amount(amount), unit)
    return rows.select(F.lit(2).alias("section"), number.cast("bigint").alias("position"), line.alias("value"))


def comparison_report(result: TableComparison, differences: DataFrame | None = None) -> DataFrame:
    """``section, position, value``: the report of a table comparison; nothing runs before the result is asked for.

    Sections: 1 the summary, 2 what differs in structure, 3 and 4 the samples of rows on one side only, 5 and 6 both definitions.
    """
    names, c = result.names, F.col
    differences = result.structure if differences is None else differences
    counted = differences.agg(F.count("*").alias("structure_differences"))
    summary = result.summary.join(F.broadcast(counted))  # one row each
    equal = c("structure_differences") == 0
    overall = F.when(equal & c("data_compared") & c("data_equal"), "EQUAL").otherwise("DIFFERENT")
    data = F.when(~c("data_compared"), "NOT COMPARED").when(c("data_equal"), "EQUAL").otherwise("DIFFERENT")
    compared = c("data_compared")
    parts = [_sections(summary, 1, [
        _text("Table comparison"), _text(f"Table: {result.table_name}"), _text(f"Direction: {names[0]} -> {names[1]}"), _text(""),
        _text("Overall: ", overall), _text("Structure: ", F.when(equal, "EQUAL").otherwise("DIFFERENT")), _text("Data: ", data), _text(""),
        _text(f"Rows in {names[0]}: ", _amount("source_row_count")), _text(f"Rows in {names[1]}: ", _amount("target_row_count")),
        F.when(compared, _text(f"Rows only in {names[0]}: ", _amount("only_source_count"))).otherwise(_text("Not compared: ", c("data_skip_reason"))),
        F.when(compared, _text(f"Rows only in {names[1]}: ", _amount("only_target_count"))),
        F.when(compared, _text(f"Columns: {', '.join(result.columns)}")),
    ])]
    order = Window.orderBy("impact_rank", "type", "object_name", "description")  # the differences of one table
    line = _text("  [", c("impact"), "] ", c("type"), ": ", c("description"))
    parts.append(differences.select(F.lit(2).alias("section"), F.row_number().over(order).cast("bigint").alias("position"), line.alias("value")))
    for section, side in ((3, "source"), (4, "target")):
        rows = result.samples(side)
        if rows is not None:
            shown = F.concat_ws(", ", *[_text(f"{n}=", F.coalesce(c(f"`{n}`").cast("string"), F.lit("NULL"))) for n in rows.columns])
            place = F.row_number().over(Window.orderBy(*sort_columns(rows)))  # at most the sample's size
            parts.append(rows.select(F.lit(section).alias("section"), place.cast("bigint").alias("position"), shown.alias("value")))
    for section, side in ((5, "source"), (6, "target")):
        parts.append(_sections(result.ddl(side), section, [c("ddl")]))
    return balanced_union(parts)


def write_report(sections: DataFrame, path: str) -> None:
    """Text files whose order by name is the order of the lines."""
    sections.orderBy("section", "position").select("value").write.mode("overwrite").text(path)


def comparison_lines(result: TableComparison, spark_status: DataFrame) -> DataFrame:
    """A table comparison as ``position, value``; sample rows stay in Spark as JSON text."""
    s, names = spark_status.first(), result.names
    head = [
        "Table comparison", f"Table: {result.table_name}", f"Direction: {names[0]} -> {names[1]}", "",
        f"Overall: {s.overall_status}", f"Structure: {s.structure_status}", f"Data: {s.data_status}", "",
        f"Rows in {names[0]}: {s.source_row_count}", f"Rows in {names[1]}: {s.target_row_count}",
    ]
    if s.data_compared:
        head += [
            f"Rows only in {names[0]}: {s.only_source_count}",
            f"Rows only in {names[1]}: {s.only_target_count}",
            f"Columns: {', '.join(result.columns)}",
        ]
    else:
        head.append(f"Not compared: {s.data_skip_reason}")
    spark = spark_status.sparkSession
    parts = [(1, "\n".join(head) + "\n\nStructure:")]
    frames = [spark.createDataFrame(parts, "section INT, value STRING")]
    frames.append(
        result.structure.select(F.lit(2).alias("section"), _text("  [", F.col("impact"), "] ", F.col("type"), ": ", F.col("description")).alias("value"))
    )
    if s.data_compared and not s.data_equal:
        for section, name, side in ((3, names[0], "source"), (5, names[1], "target")):
            rows = result.samples(side)
            frames.append(spark.createDataFrame([(section, f"\nSample rows only in {name}:")], "section INT, value STRING"))
            text = F.to_json(F.struct(*[f"`{c}`" for c in rows.columns]))
            frames.append(rows.select(F.lit(section + 1).alias("section"), text.alias("value")))
    for section, name, side in ((7, names[0], "source"), (8, names[1], "target")):
        frames.append(result.ddl(side).select(F.lit(section).alias("section"), _text(f"\nDefinition in {name}:\n", F.col("ddl")).alias("value")))
    return reduce(DataFrame.unionByName, frames)


def write_comparison_report(result: TableComparison, path: str) -> None:
    summary = status(result.summary, result.structure.count())
    lines = comparison_lines(result, summary)
    lines.orderBy("section").select("value").write.mode("overwrite").text(path)


def write_text_report(spark, lines: Sequence[str], path: str) -> None:
    """A report whose lines are already on the driver, such as a plan."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "position BIGINT, value STRING")
    write_lines(rows, path)
