"""Structure of tables compared in both directions, and the full DDL text of a table.

The operators work on every table that two catalogs share at once; ``Catalog.only_table`` narrows
them to one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import ddl
from tablecheck.functions.text import constraint_text, strip_end
from tablecheck.functions.unions import balanced_union
from tablecheck.model import DIFF_COLUMNS, Catalog
from tablecheck.operators.drift import _array, _side, _text, diff_rows, same_column


def _shared(df: DataFrame, other: Catalog) -> DataFrame:
    return df.join(other.tables.select("table_name"), "table_name", "left_semi")


def columns_compared(source: Catalog, target: Catalog, names=("source", "target")) -> DataFrame:
    """COLUMN_MISSING, COLUMN_DIFFERENT and EXTRA_COLUMN from one full join."""
    sides = [
        _shared(a.columns, b).select("table_name", "column_name", "is_nullable", ddl.column_signature().alias("sig"))
        for a, b in ((source, target), (target, source))
    ]
    s, t = _side("s"), _side("t")
    joined = sides[0].alias("s").join(sides[1].alias("t"), same_column("s", "t"), "full_outer")
    joined = joined.filter(~s("sig").eqNullSafe(t("sig")))
    missing, extra = t("column_name").isNull(), s("column_name").isNull()
    kind = F.when(missing, "COLUMN_MISSING").when(extra, "EXTRA_COLUMN").otherwise("COLUMN_DIFFERENT")
    impact = (
        F.when(missing & (s("is_nullable") == "NO"), "CRITICAL")
        .when(missing | extra, "MEDIUM")
        .otherwise("HIGH")
    )
    name = F.coalesce(s("column_name"), t("column_name"))
    description = (
        F.when(missing, _text("Column '", name, f"' exists in {names[0]} and not in {names[1]}."))
        .when(extra, _text("Column '", name, f"' exists in {names[1]} and not in {names[0]}."))
        .otherwise(_text("Column '", name, "' has another definition."))
    )
    return diff_rows(
        joined, kind, impact, name, "", description, "",
        F.when(~extra, ddl.signature_text("s.sig")), F.when(~missing, ddl.signature_text("t.sig")),
        table=F.coalesce(s("table_name"), t("table_name")), stage=F.when(extra, 2).otherwise(1),
    )


def table_constraints(catalog: Catalog) -> DataFrame:
    """Constraints that take part in comparisons: all but those that only say NOT NULL."""
    return catalog.constraints.filter(F.col("constraint_type") != "n")


def matched_objects(source: Catalog, target: Catalog, either: bool = True) -> DataFrame:
    """Constraints and indexes of both sides, matched by name and then by text, from one scan of each.

    ``kind`` is CONSTRAINT or INDEX; ``s`` and ``t`` are structs of ``sig, definition, constraint_type``, NULL where the
    side has no object of the name. ``elsewhere``: the other side has the same text under another name. ``t_index``: the
    target has an index of the name. Indexes named like a constraint of their table belong to it and are left out; with
    ``either`` the source's constraints count for the target's indexes too. Objects without a table are left out.
    """
    c = F.col

    def slot(df: DataFrame, name: str, definition: str, which: int, kind: Column) -> DataFrame:
        return df.filter("table_name IS NOT NULL").select(
            "table_name", c(name).alias("name"), F.lit(which).cast("byte").alias("slot"), c(definition).alias("definition"),
            kind.cast("string").alias("constraint_type"),
        )

    parts = []
    for side, catalog in enumerate((source, target)):
        parts.append(slot(table_constraints(catalog), "constraint_name", "definition", 2 * side, c("constraint_type")))
        parts.append(slot(catalog.indexes, "index_name", "indexdef", 2 * side + 1, F.lit(None)))
    slots = ("s_con", "s_idx", "t_con", "t_idx")
    # One shuffle, by table, serves all groups below and what the result is joined with by table.
    dealt = reduce(DataFrame.unionByName, parts).repartition("table_name")
    sig = F.when(c("slot").isin(0, 2), constraint_text(c("definition"))).otherwise(c("definition"))
    dealt = dealt.select("table_name", "name", "slot", F.struct(sig.alias("sig"), "definition", "constraint_type").alias("held"))
    # Names are unique within a table, so a group has at most one object per slot.
    named = dealt.groupBy("table_name", "name").agg(*[F.max(F.when(c("slot") == i, c("held"))).alias(x) for i, x in enumerate(slots)])
    theirs = c("t_con").isNull() & c("s_con").isNull() if either else c("t_con").isNull()
    both = F.explode(F.array(
        F.struct(F.lit("CONSTRAINT").alias("kind"), c("s_con").alias("s"), c("t_con").alias("t")),
        F.struct(F.lit("INDEX").alias("kind"), F.when(c("s_con").isNull(), c("s_idx")).alias("s"), F.when(theirs, c("t_idx")).alias("t")),
    ))
    rows = named.select("table_name", "name", c("t_idx").isNotNull().alias("t_index"), both.alias("o")).select("table_name", "name", "t_index", "o.*")
    rows = rows.filter("s IS NOT NULL OR t IS NOT NULL")
    # Each object goes to its own text, and the target's other text is noted where the two differ.
    row = F.struct("name", "t_index", "s", "t")
    own = F.struct(
        F.coalesce("s.sig", "t.sig").alias("sig"), c("s").isNotNull().alias("in_s"),
        (c("t").isNotNull() & (c("s").isNull() | c("t.sig").eqNullSafe(c("s.sig")))).alias("in_t"), row.alias("row"),
    )
    other = F.struct(c("t.sig").alias("sig"), F.lit(False).alias("in_s"), F.lit(True).alias("in_t"), F.lit(None).alias("row"))
    differ = c("s").isNotNull() & c("t").isNotNull() & ~c("s.sig").eqNullSafe(c("t.sig"))
    texts = rows.select("table_name", "kind", F.explode(F.when(differ, F.array(own, other)).otherwise(F.array(own))).alias("x"))
    # A group holds the objects of one table that have the same text.
    grouped = texts.groupBy("table_name", "kind", "x.sig").agg(
        F.bool_or("x.in_s").alias("in_s"), F.bool_or("x.in_t").alias("in_t"), F.collect_list("x.row").alias("held"),
    )
    flat = grouped.select("table_name", "kind", "sig", "in_s", "in_t", F.explode("held").alias("r")).select("*", "r.*").drop("r")
    known = c("sig").isNotNull()
    return flat.select(
        "table_name", "kind", "name", "s", "t", "t_index",
        F.when(c("t").isNull(), known & c("in_t")).when(c("s").isNull(), known & c("in_s")).otherwise(False).alias("elsewhere"),
    )


def structure_diff(source: Catalog, target: Catalog, names=("source", "target")) -> DataFrame:
    """Columns, constraints and indexes of all shared tables, both directions."""
    shared = source.tables.select("table_name").join(target.tables.select("table_name"), "table_name", "left_semi")
    objects = matched_objects(source, target).filter(~F.col("s.sig").eqNullSafe(F.col("t.sig")) & ~F.col("elsewhere"))
    objects = objects.join(shared, "table_name", "left_semi")
    name, index = F.col("name"), F.col("kind") == "INDEX"
    missing, extra = F.col("t").isNull(), F.col("s").isNull()
    found = diff_rows(
        objects, F.when(index, "INDEX_DIFFERENT").otherwise("CONSTRAINT_DIFFERENT"),
        F.when(extra, "MEDIUM").otherwise("HIGH"), name, "",
        F.when(missing, _text("'", name, f"' exists in {names[0]} and not in {names[1]}."))
        .when(extra, _text("'", name, f"' exists in {names[1]} and not in {names[0]}."))
        .otherwise(_text("'", name, "' has another definition.")),
        "", F.col("s.definition"), F.col("t.definition"), table=F.col("table_name"),
        stage=F.when(index, 4).otherwise(3),
    )
    return columns_compared(source, target, names).unionByName(found).select(*DIFF_COLUMNS)


def table_ddl(catalog: Catalog) -> DataFrame:
    """One text per table: CREATE TABLE, its constraints by name, its other indexes by name.

    All objects are shuffled once, by table. A group is bounded by the size of one table's definition.
    """
    schema, c = F.lit(catalog.schema), F.col

    def part(df: DataFrame, kind: int, position: Column, name: Column, text: Column) -> DataFrame:
        return df.select(
            "table_name", F.lit(kind).cast("byte").alias("kind"), position.cast("int").alias("position"),
            name.cast("string").alias("name"), text.cast("string").alias("text"),
        )

    nothing, known = F.lit(None), "table_name IS NOT NULL"
    parts = [
        part(catalog.columns.filter(known), 0, c("ordinal_position"), c("column_name"), ddl.column_clause()),
        part(table_constraints(catalog).filter(known), 1, nothing, c("constraint_name"), c("definition")),
        part(catalog.indexes.filter(known), 2, nothing, c("index_name"), c("indexdef")),
        part(catalog.tables, 3, nothing, nothing, nothing),
    ]
    dealt = balanced_union(parts).repartition("table_name")
    text = F.when(c("kind") == 1, ddl.add_constraint(schema, c("table_name"), c("name"), c("text")))
    text = text.when(c("kind") == 2, F.concat(strip_end(c("text")), F.lit(";"))).otherwise(c("text"))
    row = F.struct("position", "name", text.alias("text"))
    packed = [F.sort_array(F.collect_list(F.when(c("kind") == k, row))).alias(n) for k, n in enumerate(("clauses", "constraints", "indexes"))]
    tables = dealt.groupBy("table_name").agg(*packed, F.count_if(c("kind") == 3).cast("int").alias("n")).filter("n > 0")
    # Indexes named like a constraint of their table belong to it.
    backs = lambda x: F.coalesce(F.array_contains(c("constraints.name"), x["name"]), F.lit(False))
    create = ddl.create_table(schema, c("table_name"), c("clauses.text"))
    whole = F.concat_ws("\n\n", create, c("constraints.text"), F.filter("indexes", lambda x: ~backs(x))["text"])
    # As many rows as the catalog lists the table.
    return tables.select("table_name", whole.alias("ddl"), F.explode(F.sequence(F.lit(1), "n"))).drop("col")
