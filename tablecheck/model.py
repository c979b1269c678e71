"""Data model: sides, catalog snapshots, rules and the schemas of results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Impact levels, most severe first.
IMPACTS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# Type names that count as text for the empty-text check.
TEXT_TYPES = ("character varying", "character", "text")

# Foreign-key columns that only record who changed a row: none unless a caller names them.
AUDIT_COLUMNS: tuple[str, ...] = ()

REVIEW_LIMIT = 50
SAMPLE_SIZE = 20


DIFF_DDL = (
    "stage INT, type STRING, impact STRING, impact_rank INT, object_table STRING, object_name STRING, "
    "impact_reason STRING, description STRING, sql STRING, source_definition STRING, target_definition STRING"
)
DIFF_COLUMNS = [part.split()[0] for part in DIFF_DDL.split(", ")]

FINDING_DDL = (
    "stage INT, type STRING, impact STRING, impact_rank INT, rule_name STRING, table_name STRING, "
    "columns ARRAY<STRING>, impact_reason STRING, description STRING, count BIGINT, review_sql STRING, "
    "fix_sql STRING"
)
FINDING_COLUMNS = [part.split()[0] for part in FINDING_DDL.split(", ")]

# One snapshot table per kind of catalog object; each also has a leading ``env STRING``.
CATALOG_DDL = {
    "schemas": "schema_name STRING",
    "tables": "table_name STRING, table_type STRING",
    "columns": (
        "table_name STRING, column_name STRING, ordinal_position INT, column_default STRING, "
        "is_nullable STRING, data_type STRING, udt_name STRING, character_maximum_length INT, "
        "numeric_precision INT, numeric_scale INT, datetime_precision INT, identity_kind STRING, "
        "identity_generation STRING, generated_kind STRING, generation_expression STRING, "
        "collation_name STRING, comment STRING, formatted_type STRING"
    ),
    "constraints": (
        "constraint_name STRING, table_name STRING, constraint_type STRING, definition STRING, "
        "deferrable BOOLEAN, initially_deferred BOOLEAN, on_update STRING, on_delete STRING, "
        "referenced_schema STRING, columns ARRAY<STRING>, referenced_table STRING, "
        "referenced_columns ARRAY<STRING>"
    ),
    "indexes": (
        "schema_name STRING, table_name STRING, index_name STRING, indexdef STRING, method STRING, "
        "is_unique BOOLEAN, is_primary BOOLEAN, predicate STRING, expressions STRING, "
        "columns ARRAY<STRING>, opclasses ARRAY<STRING>, comment STRING"
    ),
    "views": "view_name STRING, view_definition STRING, comment STRING",
    "matviews": "view_name STRING, view_definition STRING, comment STRING",
    "sequences": (
        "sequence_name STRING, data_type STRING, start_value BIGINT, minimum_value BIGINT, "
        "maximum_value BIGINT, increment BIGINT, cache_size BIGINT, cycle BOOLEAN, owner_table STRING, "
        "owner_column STRING"
    ),
    "functions": (
        "schema_name STRING, function_name STRING, identity_arguments STRING, arguments STRING, "
        "return_type STRING, language STRING, definition STRING, volatility STRING, "
        "security_definer BOOLEAN, strict_null_input BOOLEAN, comment STRING"
    ),
    "extensions": "extension_name STRING, version STRING, schema_name STRING",
    "triggers": (
        "table_name STRING, trigger_name STRING, definition STRING, enabled STRING, "
        "function_schema STRING, function_name STRING, function_arguments STRING"
    ),
}
CATALOG_KINDS = tuple(CATALOG_DDL)


def impact_rank(impact: Column) -> Column:
    """1 for CRITICAL up to 4 for LOW."""
    return F.array_position(F.array(*[F.lit(level) for level in IMPACTS]), impact).cast("int")


@dataclass(frozen=True)
class Catalog:
    """One environment's catalog snapshot: a DataFrame per kind of object."""

    schema: str
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    indexes: DataFrame
    schemas: DataFrame
    views: DataFrame
    matviews: DataFrame
    sequences: DataFrame
    functions: DataFrame
    extensions: DataFrame
    triggers: DataFrame
    engine: str = "postgresql"

    @classmethod
    def from_snapshot(
        cls,
        spark: SparkSession,
        parts: Mapping[str, DataFrame],
        env: str,
        schema: str = "public",
        engine: str = "postgresql",
    ) -> "Catalog":
        """Pick one environment out of snapshot tables; kinds that are not given are empty."""
        frames = {}
        for kind, ddl in CATALOG_DDL.items():
            part = parts.get(kind)
            if part is None:
                empty = [f"CAST(NULL AS {kind_of}) AS {name}" for name, kind_of in (p.split() for p in ddl.split(", "))]
                frames[kind] = spark.range(0).selectExpr(*empty)
            elif "env" in part.columns:
                frames[kind] = part.filter(F.col("env") == env).drop("env")
            else:
                frames[kind] = part
        return cls(schema=schema, engine=engine, **frames)

    def only_table(self, table: str) -> "Catalog":
        """The same catalog reduced to the objects of one table."""
        keep = {
            kind: getattr(self, kind).filter(F.col("table_name") == table)
            for kind in ("tables", "columns", "constraints", "indexes", "triggers")
        }
        rest = {kind: getattr(self, kind) for kind in CATALOG_KINDS if kind not in keep}
        return Catalog(schema=self.schema, engine=self.engine, **keep, **rest)


@dataclass(frozen=True)
class Side:
    """One of the two copies: its name, its tables and, when known, its catalog."""

    name: str
    tables: Mapping[str, DataFrame]
    catalog: Catalog | None = None
    schema: str = "public"
    engine: str = "parquet"


@dataclass(frozen=True)
class Required:
    """A column declared NOT NULL; ``text`` marks those checked for blanks as well."""

    table: str
    column: str
    text: bool = False


@dataclass(frozen=True)
class Key:
    """A primary key (``p``) or a UNIQUE rule (``u``)."""

    name: str
    table: str
    columns: tuple[str, ...]
    kind: str = "p"


@dataclass(frozen=True)
class ForeignKey:
    """A foreign key; nullability is stated per side because two rules use different sides."""

    name: str
    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    source_nullable: tuple[str, ...] = ()
    target_nullable: tuple[str, ...] = ()
    parent_schema: str = ""
    table_schema: str = ""


@dataclass(frozen=True)
class RuleSet:
    required: tuple[Required, ...] = ()
    keys: tuple[Key, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    def for_tables(self, names) -> "RuleSet":
        names = set(names)
        return RuleSet(
            tuple(r for r in self.required if r.table in names),
            tuple(k for k in self.keys if k.table in names),
            tuple(f for f in self.foreign_keys if f.table in names),
        )


@dataclass(frozen=True, order=True)
class TableRef:
    schema: str
    name: str


@dataclass(frozen=True)
class SyncResult:
    """Outcome of aligning a schema or replacing the data of one table."""

    table_name: str
    source_name: str
    target_name: str
    sync_type: str
    status: str
    statements: int
    rows_copied: int
    detail: str = ""

    def to_df(self, spark: SparkSession) -> DataFrame:
        row = (
            self.table_name, self.source_name, self.target_name, self.sync_type, self.statements,
            self.rows_copied, self.status, self.detail,
        )
        return spark.createDataFrame(
            [row],
            "table_name STRING, source_name STRING, target_name STRING, sync_type STRING, "
            "statements_executed BIGINT, rows_copied BIGINT, status STRING, detail STRING",
        ).withColumn("generated_at", F.current_timestamp().cast("timestamp_ntz"))
