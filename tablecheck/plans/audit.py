"""The whole flow: check that both sides can be read, compare their catalogs, check the data, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablecheck.model import AUDIT_COLUMNS, RuleSet, Side
from tablecheck.operators.drift import drift
from tablecheck.operators.integrity import check, rules_from_catalogs
from tablecheck.plans import report
from tablecheck.sources.tables import all_ready, source_status


@dataclass(frozen=True)
class Audit:
    status: DataFrame
    differences: DataFrame | None = None
    findings: DataFrame | None = None

    @property
    def ready(self) -> bool:
        return self.differences is not None


def run_audit(
    spark: SparkSession, source: Side, target: Side, out: str, rules: RuleSet | None = None,
    scope: str = "table", audit_columns: Sequence[str] = AUDIT_COLUMNS,
) -> Audit:
    """Write all reports and scripts below ``out``; stops after the status report if a side fails.

    Rules come from the catalogs unless given.
    """
    status = source_status(spark, source.name, source.tables, source.schema, source.engine).unionByName(
        source_status(spark, target.name, target.tables, target.schema, target.engine)
    )
    status.write.mode("overwrite").json(f"{out}/status")
    if not all_ready(status):
        return Audit(status)
    if source.catalog is None or target.catalog is None:
        raise ValueError("Both sides need a catalog.")

    # Results are written once and read back, so that every report starts from the same rows.
    drift(source.catalog, target.catalog, scope).write.mode("overwrite").parquet(f"{out}/differences")
    differences = spark.read.parquet(f"{out}/differences")
    numbers = report.numbered(differences)
    report.write_difference_report(differences, f"{out}/difference_report", numbers)
    report.write_scripts(differences, f"{out}/scripts", numbers)

    rules = rules or rules_from_catalogs(source.catalog, target.catalog)
    check(target.tables, rules, target.schema, audit_columns).write.mode("overwrite").parquet(f"{out}/findings")
    findings = spark.read.parquet(f"{out}/findings")
    report.write_finding_report(findings, f"{out}/finding_report")
    report.write_orphan_fixes(findings, f"{out}/orphan_fixes")
    return Audit(status, differences, findings)
