"""Bringing the target in line: statements and DataFrames that align a schema, and data replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions import ddl
from tablecheck.functions.text import qualify, quote_ident, sql_string
from tablecheck.functions.unions import balanced_union
from tablecheck.model import Catalog, ForeignKey, SyncResult
from tablecheck.operators.diff import column_gate
from tablecheck.operators.drift import _side, _text, move_index, same_column
from tablecheck.operators.integrity import parent_lookup
from tablecheck.operators.structure import matched_objects, table_ddl
from tablecheck.sources.store import TableStore


COLUMN_ACTIONS = ("ADD_COLUMN", "ALTER_COLUMN")


def sync_plan(source: Catalog, target: Catalog, target_table: str | None = None) -> DataFrame:
    """Statements that give the target's tables the source's structure: ``table_name, seq, action, object_name, sql``.

    Columns by position, then constraints and indexes by name. Columns the source lacks are kept. A
    source table the target lacks gets one statement that creates it in full. ``target_table`` is the
    target's spelling when a single table is compared under two spellings.
    """
    c = F.col
    schema = F.lit(target.schema)
    name_sql = sql_string(target_table) if target_table else "table_name"
    table = F.expr(name_sql)
    known = target.tables.select("table_name")

    def shared(df: DataFrame) -> DataFrame:
        return df.join(known, "table_name", "left_semi")

    def action(df: DataFrame, part: int, order: Column, kind, name: Column, sql: Column) -> DataFrame:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        return df.select(
            "table_name", F.lit(part).alias("part"), order.cast("int").alias("position"), kind.alias("action"),
            name.alias("object_name"), sql.alias("sql"),
        )

    gone = source.tables.join(known, "table_name", "left_anti")
    names = gone.select("table_name")
    absent = Catalog(**{
        **source.__dict__, "schema": target.schema, "tables": gone,
        **{kind: getattr(source, kind).join(names, "table_name", "left_semi") for kind in ("columns", "constraints")},
        "indexes": source.indexes.join(names, "table_name", "left_semi").withColumn("indexdef", move_index(c("indexdef"), F.lit(source.schema), schema)),
    })
    created = action(table_ddl(absent), 0, F.lit(0), "CREATE_TABLE", c("table_name"), c("ddl"))

    t = _side("t")
    theirs = target.columns.select("table_name", "column_name", ddl.column_signature().alias("sig"))
    columns = shared(source.columns).alias("s").join(theirs.alias("t"), same_column("s", "t"), "left")
    columns = columns.filter(~ddl.column_signature("s.").eqNullSafe(t("sig"))).select("s.*", t("sig").alias("t_sig"))
    new = c("t_sig").isNull()
    columns = action(
        columns, 1, c("ordinal_position"), F.when(new, "ADD_COLUMN").otherwise("ALTER_COLUMN"), c("column_name"),
        F.when(new, _text("ALTER TABLE ", qualify(schema, table), " ADD COLUMN ", ddl.column_clause(), ";"))
        .otherwise(ddl.alter_column(sql_string(target.schema), name_sql)),
    )

    objects = shared(matched_objects(source, target, either=False)).filter(c("s").isNotNull() & ((c("kind") == "INDEX") | ~c("elsewhere")))
    objects = objects.filter(~c("s.sig").eqNullSafe(c("t.sig"))).select(
        "table_name", "name", c("kind").alias("what"), "t_index", c("t").isNull().alias("missing"),
        c("s.definition").alias("definition"), c("s.constraint_type").alias("constraint_type"),
    )
    name, kind, missing = c("name"), c("constraint_type"), c("missing")
    add = ddl.add_constraint(schema, table, name, c("definition"))
    promoted = missing & c("t_index") & kind.isin("p", "u")
    promote = ddl.add_constraint(
        schema, table, name,
        _text(F.when(kind == "p", "PRIMARY KEY").otherwise("UNIQUE"), " USING INDEX ", quote_ident(name)),
    )
    drop = _text("ALTER TABLE ", qualify(schema, table), " DROP CONSTRAINT ", quote_ident(name), ";")
    create = move_index(c("definition"), F.lit(source.schema), schema)
    index = c("what") == "INDEX"
    others = objects.select(
        "table_name", F.when(index, 3).otherwise(2).alias("part"), F.lit(0).alias("position"),
        F.when(index & missing, "CREATE_INDEX").when(index, "REPLACE_INDEX").when(promoted, "PROMOTE_INDEX")
        .when(missing, "ADD_CONSTRAINT").otherwise("REPLACE_CONSTRAINT").alias("action"),
        name.alias("object_name"),
        F.when(index & missing, create).when(index, _text("DROP INDEX ", qualify(schema, name), ";\n", create))
        .when(promoted, promote).when(missing, add).otherwise(_text(drop, "\n", add)).alias("sql"),
    )
    # The window covers one table's statements, so it is bounded by the size of a definition.
    order = Window.partitionBy("table_name").orderBy("part", "position", "object_name")
    plan = reduce(DataFrame.unionByName, [created, columns, others])
    return plan.select("table_name", F.row_number().over(order).alias("seq"), "action", "object_name", "sql")


def align_schema(
    df: DataFrame, source_columns: Sequence[tuple[str, str, bool]], defaults: Mapping[str, str] | None = None
) -> DataFrame:
    """The target's rows under the source's columns.

    ``source_columns`` lists ``(name, Spark type, nullable)`` in order and ``defaults`` SQL expressions
    by column. Columns are cast; missing ones are added with their default or NULL; where a column
    is NOT NULL and has a default, NULLs take it. Extra columns stay, after the source's.
    """
    defaults = defaults or {}
    have = {c: f"`{c}`" for c in df.columns}
    out: list[Column] = []
    for name, kind, nullable in source_columns:
        default = F.expr(defaults[name]).cast(kind) if name in defaults else F.lit(None).cast(kind)
        if name not in have:
            value = default
        else:
            value = F.col(have[name]).cast(kind)
            if not nullable and name in defaults:
                value = F.coalesce(value, default)
        out.append(value.alias(name))
    wanted = {name for name, _, _ in source_columns}
    return df.select(*out, *[F.col(have[c]) for c in df.columns if c not in wanted])


def sync_schema(
    plan: DataFrame, source: DataFrame, store: TableStore, table: str, required: Sequence[str] = (),
    defaults: Mapping[str, str] | None = None, names=("source", "target"),
) -> SyncResult:
    """Give a stored table the source's columns, as its :func:`sync_plan` says.

    Statements on columns are carried out and counted; those on constraints and indexes are reported as left over.
    """
    counted = plan.agg(F.count_if(F.col("action").isin(*COLUMN_ACTIONS)).alias("columns"), F.count("*").alias("n")).first()
    rest = counted.n - counted.columns
    left = f" {rest} statement(s) on constraints and indexes are left over: a store of files has none." if rest else ""
    if not counted.columns:
        return SyncResult(table, *names, "SCHEMA", "UNCHANGED", 0, 0, f"The columns already match.{left}")
    wanted = [(f.name, f.dataType.simpleString(), f.name not in required) for f in source.schema.fields]
    version = store.version()
    before = store.read_all(version)[table]
    store.publish({table: align_schema(before, wanted, defaults)}, after=version)
    return SyncResult(table, *names, "SCHEMA", "COMPLETED", counted.columns, 0, f"The columns were aligned.{left}")


def parent_gate(
    source: DataFrame, target: Mapping[str, DataFrame], table: str, foreign_keys: Sequence[ForeignKey],
    names=("source", "target"),
) -> DataFrame:
    """Per foreign key of ``table`` the distinct source keys that the target's parent lacks.

    ``rule_name, parent, missing_keys, message``; an empty message lets the data pass. A table that
    refers to itself is checked against the incoming rows, since the old ones are about to go.
    """
    parts = []
    for fk in (f for f in foreign_keys if f.table == table):
        parent = source if fk.parent == table else target.get(fk.parent)
        if parent is None:
            spark = source.sparkSession
            text = f"{fk.name}: the parent table {fk.parent} is missing in {names[1]}."
            parts.append(
                spark.range(1).select(
                    F.lit(fk.name).alias("rule_name"), F.lit(fk.parent).alias("parent"),
                    F.lit(None).cast("bigint").alias("missing_keys"), F.lit(text).alias("message"),
                )
            )
            continue
        n = F.col("missing_keys")
        text = _text(f"{fk.name}: ", n.cast("string"), f" reference(s) do not exist in {names[1]}.{fk.parent}.")
        counted = parent_lookup(source, fk, parent).agg(F.count("*").alias("missing_keys"))
        parts.append(
            counted.select(
                F.lit(fk.name).alias("rule_name"), F.lit(fk.parent).alias("parent"), n,
                F.when(n > 0, text).otherwise("").alias("message"),
            )
        )
    if not parts:
        return source.sparkSession.createDataFrame(
            [], "rule_name STRING, parent STRING, missing_keys BIGINT, message STRING"
        )
    return balanced_union(parts)


def children_gate(
    source: DataFrame, target: Mapping[str, DataFrame], table: str, foreign_keys: Sequence[ForeignKey]
) -> DataFrame:
    """Per foreign key of another table onto ``table`` the rows that would be orphaned by the new data."""
    parts = [
        parent_lookup(target[fk.table], fk, source)
        .agg(F.coalesce(F.sum("rows_per_key"), F.lit(0)).alias("orphans"))
        .select(
            F.lit(fk.name).alias("rule_name"), F.lit(fk.table).alias("child"), "orphans",
            F.when(
                F.col("orphans") > 0,
                _text(f"{fk.name}: ", F.col("orphans").cast("string"), f" row(s) of {fk.table} would lose their parent."),
            ).otherwise("").alias("message"),
        )
        for fk in foreign_keys
        if fk.parent == table and fk.table != table and fk.table in target
    ]
    if not parts:
        return source.sparkSession.createDataFrame([], "rule_name STRING, child STRING, orphans BIGINT, message STRING")
    return balanced_union(parts)


def replace_data(
    source: DataFrame, store: TableStore, table: str, foreign_keys: Sequence[ForeignKey] = (),
    names=("source", "target"),
) -> SyncResult:
    """Replace the rows of a stored table by the source's, or raise and leave it as it is.

    Rows take the target's column order and types; a value that does not fit its type fails the call. They are written
    first and checked as written, and become visible only as the successor of the version that the checks have read.
    """
    version = store.version()
    target = store.read_all(version)
    if column_gate(source.columns, target[table].columns):
        raise ValueError("The data cannot be replaced because the columns differ: align the schema first.")
    path = store.stage(table, fitted(source, target[table]))
    try:
        staged = source.sparkSession.read.parquet(path)
        messages = [
            r.message
            for gate in (
                parent_gate(staged, target, table, foreign_keys, names),
                children_gate(staged, target, table, foreign_keys),
            )
            for r in gate.filter("message <> ''").select("message").collect()
        ]
        if messages:
            listed = "\n".join(f"- {m}" for m in messages)
            raise ValueError(f"The data cannot be replaced because related rows are missing.\n{listed}")
        rows = store.publish({table: path}, after=version)[table]
    except Exception:
        store.discard(path)
        raise
    return SyncResult(table, *names, "DATA", "COMPLETED", 1 + rows, rows, "The data was replaced.")


def fitted(source: DataFrame, target: DataFrame) -> DataFrame:
    """The source's rows in the target's columns and types; reading a value that does not fit is an error."""
    out = []
    for f in target.schema.fields:
        kind, value = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if source.schema[f.name].dataType == f.dataType:
            out.append(value)
            continue
        cast = F.expr(f"try_cast(`{f.name}` AS {kind})")
        error = F.raise_error(F.concat(F.lit(f"A value of {f.name} is no {kind}: "), value.cast("string"))).cast(kind)
        out.append(F.when(value.isNull() | cast.isNotNull(), cast).otherwise(error).alias(f.name))
    return source.select(*out)
