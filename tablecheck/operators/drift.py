"""Schema drift: what the source catalog has and the target lacks or defines differently.

Every operator turns objects into signatures, joins the two snapshots on key or signature and
renders statements only for the rows that differ. Columns, constraints and indexes are dealt by table, and what several operators
read of them is dealt in one form (``deal_columns``, ``deal_indexes``), which Spark then shuffles once for all. The ``render_*`` functions take these rows, the source's object as ``s``
and the target's, where it has one of that name, as ``t``; :mod:`tablecheck.operators.fleet` finds them for many
environments at once. Objects that exist in the target alone are not
reported here; see :mod:`tablecheck.operators.structure` for the comparison in both directions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import ddl
from tablecheck.functions.ddl import text_or_empty
from tablecheck.functions.text import normalize_sql, qualify, quote_ident, sql_string, strip_end, strip_text
from tablecheck.model import CATALOG_DDL, DIFF_COLUMNS, Catalog, impact_rank
from tablecheck.operators.skew import lookup

# Order in which a full run reports the kinds of difference.
STAGES = (
    "SCHEMA_MISSING", "EXTENSION_MISSING", "FUNCTION_MISSING_OR_DIFFERENT", "SEQUENCE_MISSING_OR_DIFFERENT",
    "TABLE_MISSING", "COLUMN_MISSING", "COLUMN_DIFFERENT", "CONSTRAINT_MISSING_OR_DIFFERENT",
    "INDEX_MISSING_OR_DIFFERENT", "VIEW_MISSING_OR_DIFFERENT", "MATERIALIZED_VIEW_MISSING_OR_DIFFERENT",
    "TRIGGER_MISSING_OR_DIFFERENT",
)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


Fields = Callable[[str], Column]


def _prefixed(p: str) -> Fields:
    return lambda name: F.col(p + name)


def _side(alias: str) -> Fields:
    """Columns of one side of a join by name."""
    return lambda name: F.col(f"{alias}.{name}")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def diff_rows(
    df: DataFrame, kind, impact, name: Column, reason, description: Column, sql: Column,
    source_definition: Column | str = "", target_definition: Column | str = "", table: Column | str = "",
    stage: int | Column | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Project to the schema of differences, after the columns in ``keep``."""

    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    kind, impact = col(kind), col(impact)
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), kind) if stage is None else col(stage)
    return df.select(
        *keep,
        order.cast("int").alias("stage"),
        kind.alias("type"),
        impact.alias("impact"),
        impact_rank(impact).alias("impact_rank"),
        col(table).alias("object_table"),
        name.alias("object_name"),
        col(reason).alias("impact_reason"),
        description.alias("description"),
        col(sql).alias("sql"),
        text_or_empty(col(source_definition)).alias("source_definition"),
        text_or_empty(col(target_definition)).alias("target_definition"),
    )


def schema_drift(source: Catalog, target: Catalog) -> DataFrame:
    return render_schemas(source.schemas.join(target.schemas, "schema_name", "left_anti").alias("s"))


def render_schemas(missing: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    name = F.col("s.schema_name")
    return diff_rows(
        missing, "SCHEMA_MISSING", "HIGH", name,
        "Without the schema its objects can neither be created nor resolved.",
        _text("Schema '", name, "' is missing in the target."),
        _text("CREATE SCHEMA IF NOT EXISTS ", quote_ident(name), ";"),
        keep=keep,
    )


# Marker in a definition -> extension that provides it.
MARKERS = {"pg_trgm": ("gin_trgm_ops", "similarity("), "fuzzystrmatch": ("soundex(", "dmetaphone")}
TEXT_KINDS = ("columns", "constraints", "indexes", "views", "matviews", "triggers", "functions")


def all_text(df: DataFrame) -> Column:
    """All texts of a row in lower case."""
    kinds = {"string": "{}", "array<string>": "array_join({}, '\\n')"}
    texts = [kinds[f.dataType.simpleString()].format(f.name) for f in df.schema.fields if f.dataType.simpleString() in kinds]
    return F.expr(f"lower(concat_ws('\\n', {', '.join(texts)}))")


def mentions(text: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def inferred_extensions(catalog: Catalog, dealt: DataFrame | None = None) -> DataFrame:
    """Extensions the catalog's own texts show to be in use, found in one pass over each kind.

    ``dealt`` stands for the columns, as :func:`deal_columns` gives them.
    """
    def uses(df: DataFrame) -> DataFrame:
        return df.select(all_text(df).alias("text")).agg(
            *[F.bool_or(mentions(F.col("text"), found)).alias(name) for name, found in MARKERS.items()]
        )

    found = [uses(getattr(catalog, kind)) for kind in TEXT_KINDS if dealt is None or kind != "columns"]
    if dealt is not None:
        marks = _held("marks", _COLUMN).cast("int")
        found.append(dealt.agg(*[F.bool_or(marks.bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(MARKERS)]))
    flags = reduce(DataFrame.unionByName, found)
    flags = flags.agg(*[F.bool_or(name).alias(name) for name in MARKERS])
    named = F.array(*[F.when(F.col(name), F.lit(name)) for name in MARKERS])
    return flags.select(F.explode(F.array_compact(named)).alias("extension_name"))


def extension_drift(source: Catalog, target: Catalog, dealt: DataFrame | None = None) -> DataFrame:
    needed = source.extensions.select("extension_name").unionByName(inferred_extensions(source, dealt)).distinct()
    return render_extensions(needed.join(target.extensions, "extension_name", "left_anti").alias("s"))


def render_extensions(missing: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    name = F.col("s.extension_name")
    return diff_rows(
        missing, "EXTENSION_MISSING", "HIGH", name,
        "Functions, operator classes and other definitions may depend on the extension.",
        _text("Extension '", name, "' is needed and missing in the target."),
        _text("CREATE EXTENSION IF NOT EXISTS ", quote_ident(name), ";"),
        name, keep=keep,
    )


def function_key(p: str = "") -> Column:
    c = _prefixed(p)
    return _text(c("schema_name"), ".", c("function_name"), "(", c("identity_arguments"), ")")


def function_signature() -> Column:
    return F.struct(
        text_or_empty(F.col("return_type")), text_or_empty(F.col("language")),
        normalize_sql("definition"), text_or_empty(F.col("volatility")),
        _flag(F.col("security_definer")), _flag(F.col("strict_null_input")),
    )


def function_drift(source: Catalog, target: Catalog) -> DataFrame:
    sides = [
        side.functions.select("schema_name", "function_name", "identity_arguments", "definition", function_key().alias("key"), function_signature().alias("sig"))
        for side in (source, target)
    ]
    return render_functions(_matched(*sides, ["key"]))


def render_functions(joined: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    end = F.expr(strip_text("s.definition", ends="right"))
    return diff_rows(
        joined, "FUNCTION_MISSING_OR_DIFFERENT", "HIGH", function_key("s."),
        "Defaults, generated columns, constraints, indexes, triggers or views may call the function.",
        _text("Function '", function_key("s."), "' is ", _state("t.function_name"), " in the target."),
        _text(end, ";"),
        F.col("s.definition"), F.col("t.definition"), keep=keep,
    )


def _matched(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source objects whose namesake in the target is absent or has another signature."""
    s, t = source.alias("s"), target.alias("t")
    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys]
    return s.join(t, on, "left").filter(~F.col("s.sig").eqNullSafe(F.col("t.sig")))


def _without(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Objects whose signature does not occur in ``found``; signatures name the table, so none is frequent.

    A hash goes first in the join keys, so that sorting and comparing rarely look at the signature.
    """
    sides = [df.withColumn("sig_hash", F.xxhash64("sig")) for df in (wanted, found)]
    return sides[0].join(sides[1], ["sig_hash", "sig"], "left_anti")


def _same(a: Column, b: Column) -> Column:
    """Whether two values are equal, in a form that does not become a key of a join."""
    return F.array_contains(F.array(a), b)


def _unmatched(wanted: DataFrame, found: DataFrame, same: Column) -> DataFrame:
    """Objects for which ``same`` holds with none that ``found`` has for their table (``of_table``).

    Both are dealt by table alone. An anti join would be moved into the parts of a union, each of which would shuffle ``found``.
    """
    rows = wanted.withColumn("__table", _of_table())
    return rows.join(found, (F.col("__table") == F.col("of_table")) & same, "left").filter("of_table IS NULL").select(*wanted.columns)


def _state(target_key: str) -> Column:
    return F.when(F.col(target_key).isNull(), "missing").otherwise("different")


def sequence_text(c: Fields) -> Column:
    parts = ("data_type", "start_value", "increment", "minimum_value", "maximum_value", "cache_size", "cycle",
             "owner_table", "owner_column")
    return F.concat_ws(", ", *[_text(f"{p}=", text_or_empty(c(p).cast("string"))) for p in parts])


def sequence_statements(schema: Column, c: Fields, exists: Column) -> Column:
    """CREATE for a missing sequence, ALTER for a different one, and its owner when it has one."""
    name = qualify(schema, c("sequence_name"))
    options = _text(
        "INCREMENT BY ", c("increment").cast("string"), " MINVALUE ", c("minimum_value").cast("string"),
        " MAXVALUE ", c("maximum_value").cast("string"), " CACHE ", c("cache_size").cast("string"),
        F.when(_flag(c("cycle")), " CYCLE;").otherwise(" NO CYCLE;"),
    )
    create = _text(
        "CREATE SEQUENCE IF NOT EXISTS ", name, " AS ", c("data_type"), " START WITH ",
        c("start_value").cast("string"), " ", options,
    )
    alter = _text("ALTER SEQUENCE ", name, " ", options)
    owned = (text_or_empty(c("owner_table")) != "") & (text_or_empty(c("owner_column")) != "")
    owner = F.when(
        owned,
        _text("ALTER SEQUENCE ", name, " OWNED BY ", qualify(schema, c("owner_table")), ".",
              quote_ident(c("owner_column")), ";"),
    )
    return F.concat_ws("\n", F.when(exists, alter).otherwise(create), owner)


def sequence_signature() -> Column:
    return F.struct(
        text_or_empty(F.col("data_type")),
        *[F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in
          ("start_value", "increment", "minimum_value", "maximum_value", "cache_size")],
        _flag(F.col("cycle")), text_or_empty(F.col("owner_table")), text_or_empty(F.col("owner_column")),
    )


def sequence_drift(source: Catalog, target: Catalog) -> DataFrame:
    sides = [side.sequences.withColumn("sig", sequence_signature()) for side in (source, target)]
    return render_sequences(_matched(*sides, ["sequence_name"]), F.lit(target.schema))


def render_sequences(joined: DataFrame, schema: Column, keep: Sequence[str] = ()) -> DataFrame:
    s, t = _side("s"), _side("t")
    present = t("sequence_name").isNotNull()
    return diff_rows(
        joined, "SEQUENCE_MISSING_OR_DIFFERENT", "HIGH", s("sequence_name"),
        "Inserts that draw values from the sequence may fail.",
        _text("Sequence '", s("sequence_name"), "' is ", _state("t.sequence_name"), " in the target."),
        sequence_statements(schema, s, present),
        sequence_text(s), F.when(present, sequence_text(t)), keep=keep,
    )


def table_columns_text(columns: DataFrame) -> DataFrame:
    """Per table its column clauses in order; a group holds no more than one table's columns."""
    packed = F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "clause")))
    return (
        columns.select("table_name", "ordinal_position", "column_name", ddl.column_clause().alias("clause"))
        .groupBy("table_name")
        .agg(packed.alias("packed"))
        .select("table_name", F.transform("packed", lambda x: x["clause"]).alias("clauses"))
    )


# Fields of a column that pass the shuffle, with its rendered type in place of what that is made of.
_COLUMN = (
    "column_name", "ordinal_position", "column_default", "is_nullable", "identity_kind", "identity_generation", "generated_kind",
    "generation_expression", "collation_name", "comment", "type", "marks",
)
_INDEX = ("table_name", "index_name", "indexdef", "method", "is_unique", "predicate", "expressions", "columns", "opclasses")
# Stands for no table where columns are dealt: no server takes it for a name.
_NOWHERE = "\0"


def deal_columns(columns: DataFrame) -> DataFrame:
    """``of_table, held``: the columns of a snapshot, dealt by table.

    ``held`` is an array of the texts of ``_COLUMN``: since no reader can leave out a part of it before the shuffle, all readers
    share one. ``marks`` has a bit for each extension that the column's texts mention.
    """
    bits = [F.when(mentions(F.col("text"), found), 1 << k).otherwise(0) for k, found in enumerate(MARKERS.values())]
    rows = columns.withColumns({"text": all_text(columns), "type": ddl.type_text()}).withColumn("marks", reduce(lambda a, b: a + b, bits))
    held = F.array(*[F.col(n).cast("string") for n in _COLUMN]).alias("held")
    return rows.select(F.coalesce("table_name", F.lit(_NOWHERE)).alias("of_table"), held).repartition("of_table")


def dealt_columns(dealt: DataFrame, tables: DataFrame) -> DataFrame:
    """The columns of some tables, of those that :func:`deal_columns` gives, as a snapshot has them but for the type:
    ``formatted_type`` and ``data_type`` are the rendered one, the parts of which it is made NULL."""
    # A semi join would be moved before the shuffle, which would then be another one for each reader.
    of = tables.select(F.col("table_name").alias("of")).distinct()
    rows = dealt.join(of, F.col("of_table") == F.col("of"))
    given = {"data_type": "type", "formatted_type": "type", **{n: n for n in _COLUMN}}
    fields = [part.split() for part in CATALOG_DDL["columns"].split(", ")]
    values = [_held(given[n], _COLUMN).cast(kind).alias(n) if n in given else F.lit(None).cast(kind).alias(n) for n, kind in fields if n != "table_name"]
    return rows.select(F.col("of_table").alias("table_name"), *values)


def _held(name: str, fields: Sequence[str]) -> Column:
    return F.col("held")[fields.index(name)]


def _of_table() -> Column:
    """What objects of a table are dealt by; those without a table go together."""
    return text_or_empty(F.col("table_name"))


def table_drift(source: Catalog, target: Catalog, dealt: DataFrame | None = None) -> DataFrame:
    """``dealt`` stands for the source's columns, as :func:`deal_columns` gives them."""
    missing = source.tables.select("table_name").join(target.tables, "table_name", "left_anti")
    if dealt is None:
        columns = source.columns.join(missing, "table_name", "left_semi")
    else:
        columns = dealt_columns(dealt, missing)
    clauses = table_columns_text(columns)
    return render_tables(missing.join(clauses, "table_name", "left").alias("s"), F.lit(source.schema), F.col("clauses"))


def render_tables(missing: DataFrame, schema: Column, clauses: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``schema`` is the source's."""
    name = F.col("s.table_name")
    return diff_rows(
        missing, "TABLE_MISSING", "CRITICAL", name,
        "Data the application expects can be neither stored nor read.",
        _text("Table '", schema, ".", name, "' is missing in the target."),
        ddl.create_table(schema, name, _array(clauses)),
        table=name, keep=keep,
    )


def missing_column_impact(c: Fields) -> tuple[Column, Column]:
    """Impact and reason of a missing column, by whether it is required and has a default."""
    required, has_default = c("is_nullable") == "NO", c("column_default").isNotNull()
    impact = (
        F.when(required & ~has_default, "CRITICAL").when(required | has_default, "HIGH").otherwise("MEDIUM")
    )
    reason = (
        F.when(required & ~has_default, "NOT NULL without a default: every insert has to name this column.")
        .when(required, "NOT NULL with a default: the target lacks a value that each source row has.")
        .when(has_default, "Nullable with a default: the same insert leaves different rows.")
        .otherwise("Nullable without a default: only readers of this column notice.")
    )
    return impact, reason


def deal_indexes(indexes: DataFrame) -> DataFrame:
    """``of_table, held``: the indexes of a snapshot, dealt by table, in one form for all readers as in :func:`deal_columns`."""
    texts = [F.to_json(n) if n in ("columns", "opclasses") else F.col(n).cast("string") for n in _INDEX]
    return indexes.select(_of_table().alias("of_table"), F.array(*texts).alias("held")).repartition("of_table")


def dealt_indexes(dealt: DataFrame) -> DataFrame:
    """The indexes that :func:`deal_indexes` gives, with ``of_table``."""
    kinds = {"columns": "array<string>", "opclasses": "array<string>", "is_unique": "boolean"}
    values = [_held(n, _INDEX) if kinds.get(n, "string") == "string" else F.from_json(_held(n, _INDEX), kinds[n]) for n in _INDEX if n != "is_unique"]
    names = [n for n in _INDEX if n != "is_unique"]
    return dealt.select("of_table", *[v.alias(n) for v, n in zip(values, names)], _held("is_unique", _INDEX).cast("boolean").alias("is_unique"))


def _index_lists(dealt: DataFrame) -> DataFrame:
    """Per table its indexes, sorted by name; those without a table are in no list."""
    rows = dealt_indexes(dealt)
    packed = F.collect_list(F.when(F.col("table_name").isNotNull(), F.struct("index_name", "indexdef", "columns")))
    return rows.groupBy("of_table").agg(F.sort_array(packed).alias("indexes"))


def dependent_indexes(indexes: Column, column: Column) -> Column:
    """Those of a table's indexes that list the column or mention it in their definition."""
    return F.filter(
        indexes,
        lambda i: _flag(F.array_contains(i["columns"], column))
        | _flag(F.contains(F.lower(i["indexdef"]), F.lower(column))),
    )


def recreate_generated(schema: Column, table: Column, p: str, indexes: Column) -> Column:
    """A plain column cannot become a generated one: drop it and its indexes, then add both again."""
    column, full = quote_ident(F.col(f"{p}column_name")), qualify(schema, table)
    drops = F.transform(
        indexes, lambda i: F.concat(F.lit("DROP INDEX IF EXISTS "), qualify(schema, i["index_name"]), F.lit(";"))
    )
    creates = F.transform(indexes, lambda i: F.concat(strip_end(i["indexdef"]), F.lit(";")))
    return F.concat_ws(
        "\n",
        _text("-- CAUTION: this drops and computes anew all values of ", full, ".", column, "."),
        F.lit("-- Look first at the views and functions that read it."),
        drops,
        _text("ALTER TABLE ", full, " DROP COLUMN IF EXISTS ", column, ";"),
        _text("ALTER TABLE ", full, " ADD COLUMN ", column, " ", ddl.type_text(p), ddl.generated_clause(p),
              ddl.null_clause(p), ";"),
        creates,
    )


def same_column(s: str, t: str) -> Column:
    """Whether two sides of a join have a column of one table and name.

    Only the table is a key of the join, so that what is dealt by table for other steps is not dealt again; names are compared within
    a table. A text that starts with another, and the other with it, is equal to it.
    """
    a, b = F.col(f"{s}.column_name"), F.col(f"{t}.column_name")
    return (F.col(f"{s}.table_name") == F.col(f"{t}.table_name")) & F.startswith(a, b) & F.startswith(b, a)


def column_drift(source: Catalog, target: Catalog, dealt: DataFrame | None = None) -> DataFrame:
    """COLUMN_MISSING and COLUMN_DIFFERENT from a single join of the two column tables.

    ``dealt`` stands for the source's columns, as :func:`deal_columns` gives them.
    """
    of_target = target.tables.select("table_name")
    if dealt is None:
        present = source.columns.join(of_target, "table_name", "left_semi")
    else:
        present = dealt_columns(dealt, of_target)
    theirs = target.columns.select("table_name", "column_name", ddl.column_signature().alias("sig"))
    joined = present.alias("s").join(theirs.alias("t"), same_column("s", "t"), "left")
    # The source's signature is made after the join, so that it is not shuffled.
    own = F.struct(*[F.col(f"s.{n}") for n in present.columns], ddl.column_signature("s.").alias("sig"))
    joined = joined.filter(~ddl.column_signature("s.").eqNullSafe(F.col("t.sig")))
    joined = joined.select(F.col("s.table_name").alias("of_column"), own.alias("s"), F.struct(F.col("t.column_name"), F.col("t.sig")).alias("t"))
    # A column of its own, since a comparison with a fixed value would become a key of the join and deal both sides anew.
    joined = joined.withColumn("again", _flag(regenerated("s.sig", "t.sig")))
    lists = _index_lists(deal_indexes(target.indexes))
    joined = joined.join(lists, (F.col("of_column") == F.col("of_table")) & F.col("again"), "left")
    return render_columns(joined, F.lit(target.schema), sql_string(target.schema), F.col("indexes"))


def regenerated(source_signature: str, target_signature: str) -> Column:
    """Whether the source generates the column and the target does not, or by another expression."""
    s, t = _side(source_signature), _side(target_signature)
    differs = (s("generated") != t("generated")) | (s("expression") != t("expression"))
    return t("type").isNotNull() & s("generated").eqNullSafe("s") & differs


def render_columns(joined: DataFrame, schema: Column, schema_sql: str, indexes: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``s`` and ``t`` with ``sig``, their signatures; ``schema``, also as an SQL expression, is the target's, and ``indexes`` are
    the target's on the column's table."""
    s, t = _side("s"), _side("t")
    missing, generated = t("column_name").isNull(), _flag(regenerated("s.sig", "t.sig"))
    table = s("table_name")
    empty = F.array().cast("array<struct<index_name:string,indexdef:string,columns:array<string>>>")
    used = dependent_indexes(F.coalesce(indexes, empty), s("column_name"))
    impact, reason = missing_column_impact(s)
    place = _text(table, ".", s("column_name"))
    return diff_rows(
        joined,
        F.when(missing, "COLUMN_MISSING").otherwise("COLUMN_DIFFERENT"),
        F.when(missing, impact).when(generated, "CRITICAL").otherwise("HIGH"),
        s("column_name"),
        F.when(missing, reason)
        .when(generated, "Its generation rule differs, and only a new column can take another rule.")
        .otherwise("Type, nullability, default, identity, collation or generation differs."),
        F.when(missing, _text("Column '", place, "' is missing in the target."))
        .otherwise(_text("Column '", place, "' has another definition in the target.")),
        F.when(missing, _text("ALTER TABLE ", qualify(schema, table), " ADD COLUMN ", ddl.column_clause("s."), ";"))
        .when(generated, recreate_generated(schema, table, "s.", used))
        .otherwise(ddl.alter_column(schema_sql, "s.table_name", "s.")),
        F.when(~missing, ddl.signature_text("s.sig")),
        F.when(~missing, ddl.signature_text("t.sig")),
        table=table, keep=keep,
    )


def constraint_signature(scope: str = "table") -> Column:
    """Foreign keys by relation, keys by columns, the rest by definition.

    ``scope="table"`` compares within a table. ``scope="schema"`` lets the same constraint on any
    table stand in.
    """
    c = F.col
    kind = c("constraint_type")
    key, fk = kind.isin("p", "u"), kind == "f"
    other = ~key & ~fk
    return F.struct(
        (c("table_name") if scope == "table" else F.lit("")).alias("table"),
        kind.alias("kind"),
        F.when(key | fk, _array(c("columns"))).otherwise(_array(F.lit(None))).alias("columns"),
        F.when(fk, text_or_empty(c("referenced_schema"))).otherwise("").alias("parent_schema"),
        F.when(fk, text_or_empty(c("referenced_table"))).otherwise("").alias("parent"),
        F.when(fk, _array(c("referenced_columns"))).otherwise(_array(F.lit(None))).alias("parent_columns"),
        F.when(fk, text_or_empty(c("on_update"))).otherwise("").alias("on_update"),
        F.when(fk, text_or_empty(c("on_delete"))).otherwise("").alias("on_delete"),
        F.when(other, normalize_sql("definition")).otherwise("").alias("definition"),
        (~key & _flag(c("deferrable"))).alias("deferrable"),
        (~key & _flag(c("initially_deferred"))).alias("deferred"),
    )


def constraint_drift(source: Catalog, target: Catalog, scope: str = "table") -> DataFrame:
    c = F.col
    wanted = source.constraints.filter(c("constraint_type") != "n")
    # Keys of NOT NULL are not asked for.
    found = target.constraints.filter(c("constraint_type") != "n")
    if scope == "table":
        theirs = found.select(_of_table().alias("of_table"), constraint_signature(scope).alias("theirs"))
        # The source's signature is made in the join, so that it is not shuffled.
        unmatched = _unmatched(wanted, theirs, _same(F.col("theirs"), constraint_signature(scope)))
        whole = _flag(c("is_unique")) & (text_or_empty(c("predicate")) == "") & c("table_name").isNotNull()
        keys = target.indexes.filter(whole).select(_of_table().alias("of_table"), _array(c("columns")).alias("i_columns"))
        # A unique index over all rows on the same columns does the work of a key.
        on_same = c("table_name").isNotNull() & c("constraint_type").isin("p", "u") & _same(c("i_columns"), _array(c("columns")))
        missing = _unmatched(unmatched, keys, on_same)
    else:  # most keys of a schema may share one signature
        wanted = wanted.withColumn("sig", constraint_signature(scope))
        found = found.select(constraint_signature(scope).alias("sig")).distinct()
        unmatched = lookup(wanted, ["sig"], found, "known").filter("NOT known").drop("known")
        stand_in = (
            target.indexes.filter(_flag(c("is_unique")) & (text_or_empty(c("predicate")) == ""))
            .select(c("table_name").alias("i_table"), _array(c("columns")).alias("i_columns"))
            .distinct()
        )
        missing = unmatched.join(
            stand_in,
            c("constraint_type").isin("p", "u") & (c("table_name") == c("i_table"))
            & (_array(c("columns")) == c("i_columns")),
            "left_anti",
        )
    return render_constraints(missing.alias("s"), F.lit(target.schema))


def render_constraints(missing: DataFrame, schema: Column, keep: Sequence[str] = ()) -> DataFrame:
    c = _side("s")
    kind, name = c("constraint_type"), c("constraint_name")
    return diff_rows(
        missing, "CONSTRAINT_MISSING_OR_DIFFERENT",
        F.when(kind.isin("p", "f", "u"), "CRITICAL").otherwise("HIGH"), name,
        F.when(kind == "p", "Rows cannot be told apart by this key.")
        .when(kind == "f", "Rows may refer to parents that are not there.")
        .when(kind == "u", "Values that have to be unique may repeat.")
        .when(kind == "c", "Values outside the permitted range may enter.")
        .otherwise("A rule of the source is not enforced."),
        _text("No constraint equivalent to '", name, "' exists in the target."),
        ddl.add_constraint(schema, c("table_name"), name, c("definition")),
        c("definition"), table=c("table_name"), keep=keep,
    )


def index_signature(ignore_name: bool = False) -> Column:
    """``ignore_name`` leaves out the full definition, which contains the index's own name."""
    c = F.col
    parts = [
        text_or_empty(c("table_name")).alias("table"),
        text_or_empty(c("method")).alias("method"),
        _flag(c("is_unique")).alias("is_unique"),
        _array(c("columns")).alias("columns"),
        normalize_sql("expressions").alias("expressions"),
        normalize_sql("predicate").alias("predicate"),
        _array(c("opclasses")).alias("opclasses"),
    ]
    if not ignore_name:
        parts.append(normalize_sql("indexdef").alias("indexdef"))
    return F.struct(*parts)


def move_index(indexdef: Column, source_schema: Column, target_schema: Column) -> Column:
    """The index definition on the target's table: the schema of the relation after ``ON`` is replaced, quoted or plain.

    Nothing after the relation changes, so literals and expressions that mention the schema stay.
    """
    text = strip_end(indexdef)
    # CREATE [UNIQUE] INDEX [CONCURRENTLY] [IF NOT EXISTS] name ON [ONLY] schema.: names are quoted or plain.
    head = r"""(?is)^(\s*CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?:"(?:[^"]|"")*"|[^\s"]+)\s+ON\s+(?:ONLY\s+)?)((?:"(?:[^"]|"")*"|[^\s".]+)\.)"""
    start, place = F.regexp_extract(text, head, 1), F.regexp_extract(text, head, 2)
    plain = F.rlike(source_schema, F.lit("^[a-z_][a-z0-9_$]*$")) & (F.lower(place) == F.concat(source_schema, F.lit(".")))
    ours = (place == F.concat(quote_ident(source_schema), F.lit("."))) | plain
    rest = F.substr(text, F.length(start) + F.length(place) + 1)
    moved = F.when(ours, F.concat(start, quote_ident(target_schema), F.lit("."), rest)).otherwise(text)
    return F.concat(moved, F.lit(";"))


def index_drift(source: Catalog, target: Catalog, ignore_name: bool = False) -> DataFrame:
    c = F.col
    theirs = dealt_indexes(deal_indexes(target.indexes)).select("of_table", index_signature(ignore_name).alias("theirs"))
    missing = _unmatched(source.indexes, theirs, _same(c("theirs"), index_signature(ignore_name)))
    # Indexes that back a constraint are left to it; few are left to look up. (As an anti join this trips an assertion in
    # the optimizer when the snapshot is a union of scans of one table.)
    named = source.constraints.select(c("constraint_name").alias("index_name")).distinct()
    named = named.withColumn("backs", F.lit(True))
    missing = missing.join(named, "index_name", "left").filter(c("backs").isNull())
    return render_indexes(missing.alias("s"), F.lit(target.schema))


def render_indexes(missing: DataFrame, schema: Column, keep: Sequence[str] = ()) -> DataFrame:
    c = _side("s")
    return diff_rows(
        missing, "INDEX_MISSING_OR_DIFFERENT",
        F.when(text_or_empty(c("expressions")) != "", "HIGH").otherwise("MEDIUM"), c("index_name"),
        "Query plans and speed may differ without the index.",
        _text("No index equivalent to '", c("index_name"), "' exists in the target."),
        move_index(c("indexdef"), c("schema_name"), schema),
        c("indexdef"), table=c("table_name"), keep=keep,
    )


def _view_drift(source: DataFrame, target: DataFrame, schema: str, materialized: bool) -> DataFrame:
    sides = [df.withColumn("sig", normalize_sql("view_definition")) for df in (source, target)]
    return render_views(_matched(*sides, ["view_name"]), F.lit(schema), materialized)


def render_views(joined: DataFrame, schema: Column, materialized: bool, keep: Sequence[str] = ()) -> DataFrame:
    name = F.col("s.view_name")
    full = qualify(schema, name)
    body = F.expr(strip_text("s.view_definition"))
    if materialized:
        kind, impact, label = "MATERIALIZED_VIEW_MISSING_OR_DIFFERENT", "HIGH", "Materialized view '"
        reason = "Derived data and the queries on it change."
        sql = _text("DROP MATERIALIZED VIEW IF EXISTS ", full, ";\nCREATE MATERIALIZED VIEW ", full, " AS\n", body, ";")
    else:
        kind, impact, label = "VIEW_MISSING_OR_DIFFERENT", "MEDIUM", "View '"
        reason = "Queries, reports or integrations may be affected."
        sql = _text("CREATE OR REPLACE VIEW ", full, " AS\n", body, ";")
    return diff_rows(
        joined, kind, impact, name, reason,
        _text(label, name, "' is ", _state("t.view_name"), " in the target."), sql,
        F.col("s.view_definition"), F.col("t.view_definition"), keep=keep,
    )


def view_drift(source: Catalog, target: Catalog) -> DataFrame:
    return _view_drift(source.views, target.views, target.schema, materialized=False)


def matview_drift(source: Catalog, target: Catalog) -> DataFrame:
    return _view_drift(source.matviews, target.matviews, target.schema, materialized=True)


def trigger_signature() -> Column:
    c = F.col
    return F.struct(
        text_or_empty(c("table_name")).alias("table"), normalize_sql("definition").alias("definition"),
        *[text_or_empty(c(n)).alias(n) for n in
          ("enabled", "function_schema", "function_name", "function_arguments")],
    )


def trigger_drift(source: Catalog, target: Catalog) -> DataFrame:
    sides = [side.triggers.withColumn("sig", trigger_signature()) for side in (source, target)]
    return render_triggers(_without(sides[0], sides[1].select("sig")).alias("s"), F.lit(target.schema))


def render_triggers(missing: DataFrame, schema: Column, keep: Sequence[str] = ()) -> DataFrame:
    c = _side("s")
    return diff_rows(
        missing, "TRIGGER_MISSING_OR_DIFFERENT", "HIGH", c("trigger_name"),
        "Writes behave differently without the trigger.",
        _text("Trigger '", c("table_name"), ".", c("trigger_name"), "' is missing or different in the target."),
        _text("DROP TRIGGER IF EXISTS ", quote_ident(c("trigger_name")), " ON ",
              qualify(schema, c("table_name")), ";\n", c("definition"), ";"),
        c("definition"), table=c("table_name"), keep=keep,
    )


def drift(source: Catalog, target: Catalog, scope: str = "table") -> DataFrame:
    """All kinds of drift in one frame; ``stage`` carries the order of reporting."""
    dealt = deal_columns(source.columns)
    parts = [
        schema_drift(source, target),
        extension_drift(source, target, dealt),
        function_drift(source, target),
        sequence_drift(source, target),
        table_drift(source, target, dealt),
        column_drift(source, target, dealt),
        constraint_drift(source, target, scope),
        index_drift(source, target),
        view_drift(source, target),
        matview_drift(source, target),
        trigger_drift(source, target),
    ]
    return reduce(DataFrame.unionByName, parts).select(*DIFF_COLUMNS)
