"""Rendering of column types, column clauses and commented script blocks.

The functions on columns of the catalog take a prefix, '' for a plain DataFrame or ``s.`` for one side
of a join, and build one SQL expression each: a plan made of few large expressions is built faster
than one put together call by call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablecheck.functions.text import quote_ident_sql, normalize_sql_text, qualify, quote_ident


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _type(p: str) -> str:
    """The engine's own rendering when there is one, else one built from the type's parts."""
    length = f"coalesce(concat('(', CAST({p}character_maximum_length AS STRING), ')'), '')"
    scale = f"coalesce(concat(',', CAST({p}numeric_scale AS STRING)), '')"
    digits = f"coalesce(concat('(', CAST({p}numeric_precision AS STRING), {scale}, ')'), '')"
    built = f"""CASE {p}data_type
        WHEN 'character varying' THEN concat('VARCHAR', {length})
        WHEN 'character' THEN concat('CHAR', {length})
        WHEN 'numeric' THEN concat('NUMERIC', {digits})
        WHEN 'timestamp without time zone' THEN 'TIMESTAMP'
        WHEN 'timestamp with time zone' THEN 'TIMESTAMPTZ'
        WHEN 'USER-DEFINED' THEN {quote_ident_sql(p + 'udt_name')}
        WHEN 'ARRAY' THEN concat(regexp_replace({p}udt_name, '^([^_]*)_', '$1'), '[]')
        ELSE upper({p}data_type) END"""
    return f"CASE WHEN coalesce({p}formatted_type, '') <> '' THEN {p}formatted_type ELSE {built} END"


def _generated(p: str) -> str:
    return f"({p}generated_kind <=> 's' AND coalesce({p}generation_expression, '') <> '')"


def _generated_clause(p: str) -> str:
    return f"CASE WHEN {_generated(p)} THEN concat(' GENERATED ALWAYS AS (', {p}generation_expression, ') STORED') ELSE '' END"


def _default_clause(p: str) -> str:
    """DEFAULT, unless the column is generated (a generated column has no default)."""
    return f"CASE WHEN {_generated(p)} THEN '' ELSE coalesce(concat(' DEFAULT ', {p}column_default), '') END"


def _identity_clause(p: str) -> str:
    given = f"coalesce({p}identity_generation, '') <> ''"
    return f"CASE WHEN {given} THEN concat(' GENERATED ', {p}identity_generation, ' AS IDENTITY') ELSE '' END"


def _null_clause(p: str) -> str:
    return f"CASE WHEN {p}is_nullable = 'NO' THEN ' NOT NULL' ELSE '' END"


def type_text(p: str = "") -> Column:
    return F.expr(_type(p))


def generated_clause(p: str = "") -> Column:
    return F.expr(_generated_clause(p))


def null_clause(p: str = "") -> Column:
    return F.expr(_null_clause(p))


def column_clause(p: str = "") -> Column:
    """A column as it stands in CREATE TABLE or ADD COLUMN."""
    parts = (_type, _generated_clause, _default_clause, _identity_clause, _null_clause)
    rendered = ", ".join(part(p) for part in parts)
    return F.expr(f"concat({quote_ident_sql(p + 'column_name')}, ' ', {rendered})")


SIGNATURE_PARTS = (
    "type", "nullable", "default", "identity", "identity_generation", "generated", "expression", "collation", "comment",
)


def column_signature(p: str = "") -> Column:
    """Nine parts that must agree for two columns to count as the same."""
    values = (
        _type(p), f"{p}is_nullable", normalize_sql_text(f"{p}column_default"), f"coalesce({p}identity_kind, '')",
        f"coalesce({p}identity_generation, '')", f"coalesce({p}generated_kind, '')",
        normalize_sql_text(f"{p}generation_expression"), f"coalesce({p}collation_name, '')", f"coalesce({p}comment, '')",
    )
    pairs = ", ".join(f"'{name}', {value}" for name, value in zip(SIGNATURE_PARTS, values))
    return F.expr(f"named_struct({pairs})")


def signature_text(signature: str) -> Column:
    parts = ", ".join(f"coalesce({signature}.{n}, '')" for n in SIGNATURE_PARTS)
    return F.expr(f"concat_ws(' | ', {parts})")


def alter_column(schema: str, table: str, p: str = "") -> Column:
    """Statements that give an existing column the type, default, nullability and comment of the row.

    ``schema`` and ``table`` are SQL expressions.
    """
    name = quote_ident_sql(p + "column_name")
    target = f"concat({quote_ident_sql(schema)}, '.', {quote_ident_sql(table)})"
    head = f"concat('ALTER TABLE ', {target}, ' ALTER COLUMN ', {name})"
    retype = f"concat({head}, ' TYPE ', {_type(p)}, ' USING ', {name}, '::', {_type(p)}, ';')"
    default = (
        f"CASE WHEN {p}column_default IS NULL THEN concat({head}, ' DROP DEFAULT;') "
        f"ELSE concat({head}, ' SET DEFAULT ', {p}column_default, ';') END"
    )
    nullable = f"concat({head}, CASE WHEN {p}is_nullable = 'NO' THEN ' SET NOT NULL;' ELSE ' DROP NOT NULL;' END)"
    literal = f"concat('\\'', replace({p}comment, '\\'', '\\'\\''), '\\'')"
    comment = (
        f"CASE WHEN coalesce({p}comment, '') <> '' "
        f"THEN concat('COMMENT ON COLUMN ', {target}, '.', {name}, ' IS ', {literal}, ';') END"
    )
    return F.expr(f"concat_ws('\\n', {retype}, {default}, {nullable}, {comment})")


def create_table(schema: Column, table: Column, clauses: Column) -> Column:
    """CREATE TABLE from an array of column clauses in order."""
    body = F.array_join(F.transform(clauses, lambda x: F.concat(F.lit("    "), x)), ",\n")
    return F.concat(F.lit("CREATE TABLE "), qualify(schema, table), F.lit(" (\n"), body, F.lit("\n);"))


def add_constraint(schema: Column, table: Column, name: Column, definition: Column) -> Column:
    return F.concat(
        F.lit("ALTER TABLE "), qualify(schema, table), F.lit(" ADD CONSTRAINT "), quote_ident(name), F.lit(" "),
        definition, F.lit(";"),
    )


def comment_lines(text: Column) -> Column:
    """Every line of a definition as a SQL comment."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.concat(F.lit("-- "), x))
    return F.when(text_or_empty(text) == "", "-- (absent or not available)").otherwise(F.array_join(lines, "\n"))
