"""Fragments of DuckDB SQL from which the oracles are put together."""

from __future__ import annotations


def norm(x: str) -> str:
    stripped = rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"
    return rf"lower(trim(regexp_replace(regexp_replace({stripped}, ';+$', ''), '\s+', ' ', 'g'), ' '))"


def q(x: str) -> str:
    return f"('\"' || replace({x}, '\"', '\"\"') || '\"')"


def qual(schema: str, name: str) -> str:
    return f"({q(schema)} || '.' || {q(name)})"


def e(x: str) -> str:
    return f"coalesce({x}, '')"


def arr(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


def type_text(p: str) -> str:
    return (
        f"CASE WHEN {e(p + 'formatted_type')} <> '' THEN {p}formatted_type ELSE CASE {p}data_type "
        f"WHEN 'character varying' THEN 'VARCHAR' || coalesce('(' || {p}character_maximum_length || ')', '') "
        f"WHEN 'character' THEN 'CHAR' || coalesce('(' || {p}character_maximum_length || ')', '') "
        f"WHEN 'numeric' THEN 'NUMERIC' || coalesce('(' || {p}numeric_precision || coalesce(',' || {p}numeric_scale, '') || ')', '') "
        f"WHEN 'timestamp without time zone' THEN 'TIMESTAMP' WHEN 'timestamp with time zone' THEN 'TIMESTAMPTZ' "
        f"WHEN 'USER-DEFINED' THEN {q(p + 'udt_name')} "
        f"WHEN 'ARRAY' THEN regexp_replace({p}udt_name, '^([^_]*)_', '\\1') || '[]' ELSE upper({p}data_type) END END"
    )


def generated(p: str) -> str:
    return f"({e(p + 'generated_kind')} = 's' AND {e(p + 'generation_expression')} <> '')"


def generated_clause(p: str) -> str:
    return f"CASE WHEN {generated(p)} THEN ' GENERATED ALWAYS AS (' || {p}generation_expression || ') STORED' ELSE '' END"


def null_clause(p: str) -> str:
    return f"CASE WHEN {p}is_nullable = 'NO' THEN ' NOT NULL' ELSE '' END"


def column_clause(p: str) -> str:
    default = f"CASE WHEN {generated(p)} THEN '' ELSE coalesce(' DEFAULT ' || {p}column_default, '') END"
    identity = (
        f"CASE WHEN {e(p + 'identity_generation')} <> '' THEN ' GENERATED ' || {p}identity_generation || ' AS IDENTITY' ELSE '' END"
    )
    return (
        f"({q(p + 'column_name')} || ' ' || {type_text(p)} || {generated_clause(p)} || {default} || {identity} || {null_clause(p)})"
    )


def signature(p: str) -> str:
    parts = [
        type_text(p), p + "is_nullable", norm(p + "column_default"), e(p + "identity_kind"), e(p + "identity_generation"),
        e(p + "generated_kind"), norm(p + "generation_expression"), e(p + "collation_name"), e(p + "comment"),
    ]
    return f"concat_ws(' | ', {', '.join(parts)})"


def alter_column(schema: str, table: str, p: str) -> str:
    full, name = qual(schema, table), q(p + "column_name")
    head = f"'ALTER TABLE ' || {full} || ' ALTER COLUMN ' || {name}"
    retype = f"{head} || ' TYPE ' || {type_text(p)} || ' USING ' || {name} || '::' || {type_text(p)} || ';'"
    default = (
        f"CASE WHEN {p}column_default IS NULL THEN {head} || ' DROP DEFAULT;' "
        f"ELSE {head} || ' SET DEFAULT ' || {p}column_default || ';' END"
    )
    nullable = f"{head} || CASE WHEN {p}is_nullable = 'NO' THEN ' SET NOT NULL;' ELSE ' DROP NOT NULL;' END"
    comment = (
        f"CASE WHEN {e(p + 'comment')} <> '' THEN 'COMMENT ON COLUMN ' || {full} || '.' || {name} || ' IS ''' "
        f"|| replace({p}comment, '''', '''''') || ''';' END"
    )
    return f"concat_ws(chr(10), {retype}, {default}, {nullable}, {comment})"


def add_constraint(schema: str, table: str, name: str, definition: str) -> str:
    return f"('ALTER TABLE ' || {qual(schema, table)} || ' ADD CONSTRAINT ' || {q(name)} || ' ' || {definition} || ';')"


def constraint_text(x: str) -> str:
    folded = f"replace({x}, '::character varying::text', '::character varying')"
    return f"lower(replace(replace({folded}, '::text[]', ''), ' ', ''))"


def diff(stage, kind, impact, table, name, reason, description, sql, source="''", target="''", rest="") -> str:
    """A SELECT with the columns of a difference."""
    return f"""
SELECT CAST({stage} AS INT) AS stage, {kind} AS type, {impact} AS impact,
  CAST(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], {impact}) AS INT) AS impact_rank,
  {table} AS object_table, {name} AS object_name, {reason} AS impact_reason, {description} AS description,
  {sql} AS sql, coalesce({source}, '') AS source_definition, coalesce({target}, '') AS target_definition
{rest}"""
