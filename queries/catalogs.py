"""Queries on catalogs: assembly, drift, structure, statements and summaries over differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import sql
from queries.inputs import SNAPSHOT, catalogs, ctes, frame, raw, raw_ctes, oracle
from tablecheck.functions import ddl, text
from tablecheck.model import Catalog
from tablecheck.operators import align, drift, fleet, graph, integrity, purge, structure
from tablecheck.plans import report
from tablecheck.sources import catalog as builders
from tablecheck.sources.checkpoints import Scratch
from tablecheck.sources.tables import resolve_tables

QUERIES = {}
ORACLES = {}


def register(name: str, oracle_sql: str):
    def add(query):
        QUERIES[name] = query
        ORACLES[name] = oracle_sql
        return query

    return add


def with_ctes(kinds: tuple[str, ...], body: str) -> str:
    return f"WITH {ctes(*kinds)}\n{body}"


# --- drift -------------------------------------------------------------------------------------

SCHEMA_DRIFT = sql.diff(
    1, "'SCHEMA_MISSING'", "'HIGH'", "''", "schema_name",
    "'Without the schema its objects can neither be created nor resolved.'",
    "'Schema ''' || schema_name || ''' is missing in the target.'",
    f"'CREATE SCHEMA IF NOT EXISTS ' || {sql.q('schema_name')} || ';'",
    rest="FROM s_schemas WHERE schema_name NOT IN (SELECT schema_name FROM t_schemas)",
)


@register("schema_drift", with_ctes(("schemas",), SCHEMA_DRIFT))
def schema_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_drift(*catalogs(spark, folder, "schemas"))


_TEXT_KINDS = ("columns", "constraints", "indexes", "views", "matviews", "triggers", "functions")


def _uses(kind: str, marker: str) -> str:
    return f"EXISTS (SELECT 1 FROM s_{kind} x WHERE contains(lower(CAST(x AS VARCHAR)), '{marker}'))"


_PG_TRGM = " OR ".join(_uses(k, m) for k in _TEXT_KINDS for m in ("gin_trgm_ops", "similarity("))
_FUZZY = " OR ".join(_uses(k, m) for k in _TEXT_KINDS for m in ("soundex(", "dmetaphone"))
EXTENSION_DRIFT = sql.diff(
    2, "'EXTENSION_MISSING'", "'HIGH'", "''", "extension_name",
    "'Functions, operator classes and other definitions may depend on the extension.'",
    "'Extension ''' || extension_name || ''' is needed and missing in the target.'",
    f"'CREATE EXTENSION IF NOT EXISTS ' || {sql.q('extension_name')} || ';'", "extension_name",
    rest=f"""FROM (SELECT extension_name FROM s_extensions UNION SELECT 'pg_trgm' WHERE {_PG_TRGM}
  UNION SELECT 'fuzzystrmatch' WHERE {_FUZZY}) needed
WHERE extension_name NOT IN (SELECT extension_name FROM t_extensions)""",
)


@register("extension_drift", with_ctes(_TEXT_KINDS + ("extensions",), EXTENSION_DRIFT))
def extension_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.extension_drift(*catalogs(spark, folder, *_TEXT_KINDS, "extensions"))


def _fn_key(p: str) -> str:
    return f"({p}.schema_name || '.' || {p}.function_name || '(' || {p}.identity_arguments || ')')"


FUNCTION_DRIFT = sql.diff(
    3, "'FUNCTION_MISSING_OR_DIFFERENT'", "'HIGH'", "''", _fn_key("s"),
    "'Defaults, generated columns, constraints, indexes, triggers or views may call the function.'",
    f"'Function ''' || {_fn_key('s')} || ''' is ' || CASE WHEN t.function_name IS NULL THEN 'missing' ELSE 'different' END || ' in the target.'",
    r"regexp_replace(s.definition, '\s+$', '') || ';'", "s.definition", "t.definition",
    rest=f"""FROM s_functions s LEFT JOIN t_functions t ON {_fn_key('s')} = {_fn_key('t')}
WHERE t.function_name IS NULL OR s.return_type <> t.return_type OR s.language <> t.language
  OR {sql.norm('s.definition')} <> {sql.norm('t.definition')} OR s.volatility <> t.volatility
  OR s.security_definer <> t.security_definer OR s.strict_null_input <> t.strict_null_input""",
)


@register("function_drift", with_ctes(("functions",), FUNCTION_DRIFT))
def function_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.function_drift(*catalogs(spark, folder, "functions"))


def _seq_text(p: str) -> str:
    fields = ("data_type", "start_value", "increment", "minimum_value", "maximum_value", "cache_size", "cycle",
              "owner_table", "owner_column")
    return "concat_ws(', ', " + ", ".join(f"'{f}=' || coalesce(CAST({p}.{f} AS VARCHAR), '')" for f in fields) + ")"


_SEQ_NAME = sql.qual("'public'", "s.sequence_name")
_SEQ_OPTIONS = (
    "'INCREMENT BY ' || s.increment || ' MINVALUE ' || s.minimum_value || ' MAXVALUE ' || s.maximum_value || ' CACHE ' "
    "|| s.cache_size || CASE WHEN s.cycle THEN ' CYCLE;' ELSE ' NO CYCLE;' END"
)
SEQUENCE_DRIFT = sql.diff(
    4, "'SEQUENCE_MISSING_OR_DIFFERENT'", "'HIGH'", "''", "s.sequence_name",
    "'Inserts that draw values from the sequence may fail.'",
    "'Sequence ''' || s.sequence_name || ''' is ' || CASE WHEN t.sequence_name IS NULL THEN 'missing' ELSE 'different' END || ' in the target.'",
    f"""concat_ws(chr(10), CASE WHEN t.sequence_name IS NULL
    THEN 'CREATE SEQUENCE IF NOT EXISTS ' || {_SEQ_NAME} || ' AS ' || s.data_type || ' START WITH ' || s.start_value || ' ' || {_SEQ_OPTIONS}
    ELSE 'ALTER SEQUENCE ' || {_SEQ_NAME} || ' ' || {_SEQ_OPTIONS} END,
    CASE WHEN s.owner_table IS NOT NULL AND s.owner_column IS NOT NULL
    THEN 'ALTER SEQUENCE ' || {_SEQ_NAME} || ' OWNED BY ' || {sql.qual("'public'", 's.owner_table')} || '.' || {sql.q('s.owner_column')} || ';' END)""",
    _seq_text("s"), f"CASE WHEN t.sequence_name IS NOT NULL THEN {_seq_text('t')} END",
    rest=f"FROM s_sequences s LEFT JOIN t_sequences t USING (sequence_name) WHERE t.sequence_name IS NULL OR {_seq_text('s')} <> {_seq_text('t')}",
).replace("CASE WHEN t.sequence_name IS", "CASE WHEN t.data_type IS").replace("WHERE t.sequence_name IS", "WHERE t.data_type IS")


@register("sequence_drift", with_ctes(("sequences",), SEQUENCE_DRIFT))
def sequence_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.sequence_drift(*catalogs(spark, folder, "sequences"))


_CLAUSES = f"(SELECT table_name, string_agg('    ' || {sql.column_clause('')}, ',' || chr(10) ORDER BY ordinal_position) AS body FROM s_columns GROUP BY table_name)"
_CREATE = f"'CREATE TABLE ' || {sql.qual(chr(39) + 'public' + chr(39), 'o.table_name')} || ' (' || chr(10) || coalesce(c.body, '') || chr(10) || ');'"
TABLE_DRIFT = sql.diff(
    5, "'TABLE_MISSING'", "'CRITICAL'", "o.table_name", "o.table_name",
    "'Data the application expects can be neither stored nor read.'",
    "'Table ''public.' || o.table_name || ''' is missing in the target.'", _CREATE,
    rest=f"FROM s_tables o LEFT JOIN {_CLAUSES} c ON c.table_name = o.table_name WHERE o.table_name NOT IN (SELECT table_name FROM t_tables)",
)


@register("table_drift", with_ctes(("tables", "columns"), TABLE_DRIFT))
def table_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.table_drift(*catalogs(spark, folder, "tables", "columns"))


_MISSING = "t.column_name IS NULL"
_GENERATED = (
    f"(t.column_name IS NOT NULL AND s.generated_kind = 's' AND ({sql.e('t.generated_kind')} <> 's' OR "
    f"{sql.norm('s.generation_expression')} <> {sql.norm('t.generation_expression')}))"
)
_SQ, _PUB = "s.table_name", "'public'"
_FULL = sql.qual(_PUB, _SQ)
_DEP = (
    "(SELECT {agg} FROM t_indexes i WHERE i.table_name = s.table_name AND (list_contains(i.columns, s.column_name) "
    "OR contains(lower(i.indexdef), lower(s.column_name))))"
)
_DROPS = _DEP.format(agg=f"string_agg('DROP INDEX IF EXISTS ' || {sql.qual(_PUB, 'i.index_name')} || ';', chr(10) ORDER BY i.index_name)")
_CREATES = _DEP.format(agg="string_agg(regexp_replace(i.indexdef, ';+$', '') || ';', chr(10) ORDER BY i.index_name)")
_RECREATE = (
    f"concat_ws(chr(10), '-- CAUTION: this drops and computes anew all values of ' || {_FULL} || '.' || {sql.q('s.column_name')} || '.', "
    f"'-- Look first at the views and functions that read it.', {_DROPS}, "
    f"'ALTER TABLE ' || {_FULL} || ' DROP COLUMN IF EXISTS ' || {sql.q('s.column_name')} || ';', "
    f"'ALTER TABLE ' || {_FULL} || ' ADD COLUMN ' || {sql.q('s.column_name')} || ' ' || {sql.type_text('s.')} || {sql.generated_clause('s.')} || {sql.null_clause('s.')} || ';', "
    f"{_CREATES})"
)
_REQ, _DEF = "s.is_nullable = 'NO'", "s.column_default IS NOT NULL"
_PLACE = "s.table_name || '.' || s.column_name"
COLUMN_DRIFT = sql.diff(
    f"CASE WHEN {_MISSING} THEN 6 ELSE 7 END",
    f"CASE WHEN {_MISSING} THEN 'COLUMN_MISSING' ELSE 'COLUMN_DIFFERENT' END",
    f"CASE WHEN {_MISSING} AND {_REQ} AND NOT ({_DEF}) THEN 'CRITICAL' WHEN {_MISSING} AND ({_REQ} OR {_DEF}) THEN 'HIGH' "
    f"WHEN {_MISSING} THEN 'MEDIUM' WHEN {_GENERATED} THEN 'CRITICAL' ELSE 'HIGH' END",
    "s.table_name", "s.column_name",
    f"CASE WHEN {_MISSING} AND {_REQ} AND NOT ({_DEF}) THEN 'NOT NULL without a default: every insert has to name this column.' "
    f"WHEN {_MISSING} AND {_REQ} THEN 'NOT NULL with a default: the target lacks a value that each source row has.' "
    f"WHEN {_MISSING} AND {_DEF} THEN 'Nullable with a default: the same insert leaves different rows.' "
    f"WHEN {_MISSING} THEN 'Nullable without a default: only readers of this column notice.' "
    f"WHEN {_GENERATED} THEN 'Its generation rule differs, and only a new column can take another rule.' "
    "ELSE 'Type, nullability, default, identity, collation or generation differs.' END",
    f"CASE WHEN {_MISSING} THEN 'Column ''' || {_PLACE} || ''' is missing in the target.' "
    f"ELSE 'Column ''' || {_PLACE} || ''' has another definition in the target.' END",
    f"CASE WHEN {_MISSING} THEN 'ALTER TABLE ' || {_FULL} || ' ADD COLUMN ' || {sql.column_clause('s.')} || ';' "
    f"WHEN {_GENERATED} THEN {_RECREATE} ELSE {sql.alter_column(_PUB, _SQ, 's.')} END",
    f"CASE WHEN NOT ({_MISSING}) THEN {sql.signature('s.')} END",
    f"CASE WHEN NOT ({_MISSING}) THEN {sql.signature('t.')} END",
    rest=f"""FROM s_columns s LEFT JOIN t_columns t ON s.table_name = t.table_name AND s.column_name = t.column_name
WHERE s.table_name IN (SELECT table_name FROM t_tables) AND ({_MISSING} OR {sql.signature('s.')} <> {sql.signature('t.')})""",
)
_COLUMN_KINDS = ("tables", "columns", "indexes")


@register("column_drift", with_ctes(_COLUMN_KINDS, COLUMN_DRIFT))
def column_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.column_drift(*catalogs(spark, folder, *_COLUMN_KINDS))


@register(
    "fleet_column_drift",
    with_ctes(_COLUMN_KINDS, f"SELECT type, impact, count(*) AS n FROM ({COLUMN_DRIFT}) d GROUP BY type, impact"),
)
def fleet_column_drift(spark: SparkSession, folder: str) -> DataFrame:
    found = drift.column_drift(*catalogs(spark, folder, *_COLUMN_KINDS))
    return found.groupBy("type", "impact").agg(F.count("*").alias("n"))


def _con_sig(p: str, scope: str) -> str:
    parts = [
        f"{p}.table_name" if scope == "table" else "''", f"{p}.constraint_type",
        f"CASE WHEN {p}.constraint_type IN ('p', 'u', 'f') THEN {sql.arr(p + '.columns')} ELSE '' END",
        *[f"CASE WHEN {p}.constraint_type = 'f' THEN {sql.e(f'{p}.{f}')} ELSE '' END"
          for f in ("referenced_schema", "referenced_table", "on_update", "on_delete")],
        f"CASE WHEN {p}.constraint_type = 'f' THEN {sql.arr(p + '.referenced_columns')} ELSE '' END",
        f"CASE WHEN {p}.constraint_type NOT IN ('p', 'u', 'f') THEN {sql.norm(p + '.definition')} ELSE '' END",
        f"CASE WHEN {p}.constraint_type NOT IN ('p', 'u') THEN CAST({p}.deferrable AS VARCHAR) || CAST({p}.initially_deferred AS VARCHAR) ELSE '' END",
    ]
    return f"concat_ws('|', {', '.join(parts)})"


def constraint_drift_sql(scope: str) -> str:
    return sql.diff(
        8, "'CONSTRAINT_MISSING_OR_DIFFERENT'",
        "CASE WHEN s.constraint_type IN ('p', 'f', 'u') THEN 'CRITICAL' ELSE 'HIGH' END", "s.table_name", "s.constraint_name",
        "CASE s.constraint_type WHEN 'p' THEN 'Rows cannot be told apart by this key.' "
        "WHEN 'f' THEN 'Rows may refer to parents that are not there.' "
        "WHEN 'u' THEN 'Values that have to be unique may repeat.' "
        "WHEN 'c' THEN 'Values outside the permitted range may enter.' ELSE 'A rule of the source is not enforced.' END",
        "'No constraint equivalent to ''' || s.constraint_name || ''' exists in the target.'",
        sql.add_constraint("'public'", "s.table_name", "s.constraint_name", "s.definition"), "s.definition",
        rest=f"""FROM s_constraints s WHERE s.constraint_type <> 'n'
  AND {_con_sig('s', scope)} NOT IN (SELECT {_con_sig('t', scope)} FROM t_constraints t)
  AND NOT (s.constraint_type IN ('p', 'u') AND s.table_name || '|' || {sql.arr('s.columns')} IN
    (SELECT i.table_name || '|' || {sql.arr('i.columns')} FROM t_indexes i WHERE i.is_unique AND {sql.e('i.predicate')} = ''))""",
    )


@register("constraint_drift", with_ctes(("constraints", "indexes"), constraint_drift_sql("table")))
def constraint_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.constraint_drift(*catalogs(spark, folder, "constraints", "indexes"))


@register("constraint_drift_schema_scope", with_ctes(("constraints", "indexes"), constraint_drift_sql("schema")))
def constraint_drift_schema_scope(spark: SparkSession, folder: str) -> DataFrame:
    return drift.constraint_drift(*catalogs(spark, folder, "constraints", "indexes"), scope="schema")


def _idx_sig(p: str, ignore_name: bool = False) -> str:
    parts = [
        f"{p}.table_name", f"{p}.method", f"CAST({p}.is_unique AS VARCHAR)", sql.arr(f"{p}.columns"),
        sql.norm(f"{p}.expressions"), sql.norm(f"{p}.predicate"), sql.arr(f"{p}.opclasses"),
    ]
    return f"concat_ws('|', {', '.join(parts + ([] if ignore_name else [sql.norm(f'{p}.indexdef')]))})"


INDEX_DRIFT = sql.diff(
    9, "'INDEX_MISSING_OR_DIFFERENT'", f"CASE WHEN {sql.e('s.expressions')} <> '' THEN 'HIGH' ELSE 'MEDIUM' END",
    "s.table_name", "s.index_name", "'Query plans and speed may differ without the index.'",
    "'No index equivalent to ''' || s.index_name || ''' exists in the target.'",
    "regexp_replace(s.indexdef, ';+$', '') || ';'", "s.indexdef",
    rest=f"""FROM s_indexes s WHERE s.index_name NOT IN (SELECT constraint_name FROM s_constraints)
  AND {_idx_sig('s')} NOT IN (SELECT {_idx_sig('t')} FROM t_indexes t)""",
)


@register("index_drift", with_ctes(("constraints", "indexes"), INDEX_DRIFT))
def index_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.index_drift(*catalogs(spark, folder, "constraints", "indexes"))


def _view_sql(kind: str, stage: int, code: str, impact: str, label: str, reason: str, head: str) -> str:
    return sql.diff(
        stage, f"'{code}'", f"'{impact}'", "''", "s.view_name", f"'{reason}'",
        f"'{label} ''' || s.view_name || ''' is ' || CASE WHEN t.name IS NULL THEN 'missing' ELSE 'different' END || ' in the target.'",
        rf"{head} || ' AS' || chr(10) || regexp_replace(s.view_definition, '^\s+|\s+$', '', 'g') || ';'",
        "s.view_definition", "t.view_definition",
        rest=f"""FROM s_{kind} s LEFT JOIN (SELECT view_name AS name, view_definition FROM t_{kind}) t ON s.view_name = t.name
WHERE t.name IS NULL OR {sql.norm('s.view_definition')} <> {sql.norm('t.view_definition')}""",
    )


_VIEW_NAME = sql.qual("'public'", "s.view_name")
VIEW_DRIFT = _view_sql(
    "views", 10, "VIEW_MISSING_OR_DIFFERENT", "MEDIUM", "View", "Queries, reports or integrations may be affected.",
    f"'CREATE OR REPLACE VIEW ' || {_VIEW_NAME}",
)
MATVIEW_DRIFT = _view_sql(
    "matviews", 11, "MATERIALIZED_VIEW_MISSING_OR_DIFFERENT", "HIGH", "Materialized view",
    "Derived data and the queries on it change.",
    f"'DROP MATERIALIZED VIEW IF EXISTS ' || {_VIEW_NAME} || ';' || chr(10) || 'CREATE MATERIALIZED VIEW ' || {_VIEW_NAME}",
)


@register("view_drift", with_ctes(("views",), VIEW_DRIFT))
def view_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.view_drift(*catalogs(spark, folder, "views"))


@register("matview_drift", with_ctes(("matviews",), MATVIEW_DRIFT))
def matview_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.matview_drift(*catalogs(spark, folder, "matviews"))


def _trg_sig(p: str) -> str:
    names = ("enabled", "function_schema", "function_name", "function_arguments")
    return f"concat_ws('|', {p}.table_name, {sql.norm(p + '.definition')}, {', '.join(f'{p}.{n}' for n in names)})"


TRIGGER_DRIFT = sql.diff(
    12, "'TRIGGER_MISSING_OR_DIFFERENT'", "'HIGH'", "s.table_name", "s.trigger_name",
    "'Writes behave differently without the trigger.'",
    "'Trigger ''' || s.table_name || '.' || s.trigger_name || ''' is missing or different in the target.'",
    f"'DROP TRIGGER IF EXISTS ' || {sql.q('s.trigger_name')} || ' ON ' || {_FULL} || ';' || chr(10) || s.definition || ';'",
    "s.definition",
    rest=f"FROM s_triggers s WHERE {_trg_sig('s')} NOT IN (SELECT {_trg_sig('t')} FROM t_triggers t)",
)


@register("trigger_drift", with_ctes(("triggers",), TRIGGER_DRIFT))
def trigger_drift(spark: SparkSession, folder: str) -> DataFrame:
    return drift.trigger_drift(*catalogs(spark, folder, "triggers"))


ALL_DRIFT = "\nUNION ALL\n".join([
    SCHEMA_DRIFT, EXTENSION_DRIFT, FUNCTION_DRIFT, SEQUENCE_DRIFT, TABLE_DRIFT, COLUMN_DRIFT, constraint_drift_sql("table"),
    INDEX_DRIFT, VIEW_DRIFT, MATVIEW_DRIFT, TRIGGER_DRIFT,
])


@register("drift_run", with_ctes(tuple(SNAPSHOT), ALL_DRIFT))
def drift_run(spark: SparkSession, folder: str) -> DataFrame:
    return drift.drift(*catalogs(spark, folder))


# Environments of a fleet: the kinds of objects in which each has the target's state and not the source's.
FLEET = {
    "all": tuple(SNAPSHOT), "columns": ("columns",), "keys": ("constraints", "indexes"), "none": (),
    "code": ("views", "matviews", "sequences", "functions", "triggers"), "tables": ("schemas", "tables", "extensions"),
}


def _fleet_sql() -> str:
    parts = []
    for env, changed in FLEET.items():
        sides = [f"s_{k} AS ({oracle(SNAPSHOT[k](False))}), t_{k} AS ({oracle(SNAPSHOT[k](k in changed))})" for k in SNAPSHOT]
        parts.append(f"SELECT '{env}' AS env, d.* FROM (WITH {', '.join(sides)} {ALL_DRIFT}) d")
    return "\nUNION ALL\n".join(parts)


@register("fleet_drift", _fleet_sql())
def fleet_drift(spark: SparkSession, folder: str) -> DataFrame:
    """All drift of six environments against the source, whose objects are read and compared once."""
    loaded: dict[str, DataFrame] = {}
    table = fleet.SignatureTable(spark)
    for env, changed in {"source": (), **FLEET}.items():
        parts = {k: frame(spark, folder, SNAPSHOT[k](k in changed), loaded) for k in SNAPSHOT}
        table.add(env, Catalog.from_snapshot(spark, parts, env="", schema="public"))
    return table.compare("source", list(FLEET))


@register("stored_snapshots", with_ctes(tuple(SNAPSHOT), ALL_DRIFT))
def stored_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All drift between two environments that were stored one after the other and read back."""
    root = Scratch(spark).root
    for env, side in zip(("left", "right"), catalogs(spark, folder)):
        builders.write_snapshot({k: getattr(side, k).withColumn("env", F.lit(env)) for k in SNAPSHOT}, root)
    return drift.drift(*[builders.read_snapshot(spark, root, env) for env in ("left", "right")])


# --- structure in both directions ----------------------------------------------------------------

_ST = "coalesce(s.table_name, t.table_name)"
_SC = "coalesce(s.column_name, t.column_name)"
STRUCT_COLUMNS = sql.diff(
    "CASE WHEN s.column_name IS NULL THEN 2 ELSE 1 END",
    "CASE WHEN t.column_name IS NULL THEN 'COLUMN_MISSING' WHEN s.column_name IS NULL THEN 'EXTRA_COLUMN' ELSE 'COLUMN_DIFFERENT' END",
    "CASE WHEN t.column_name IS NULL AND s.is_nullable = 'NO' THEN 'CRITICAL' WHEN t.column_name IS NULL OR s.column_name IS NULL "
    "THEN 'MEDIUM' ELSE 'HIGH' END", _ST, _SC, "''",
    f"CASE WHEN t.column_name IS NULL THEN 'Column ''' || {_SC} || ''' exists in source and not in target.' "
    f"WHEN s.column_name IS NULL THEN 'Column ''' || {_SC} || ''' exists in target and not in source.' "
    f"ELSE 'Column ''' || {_SC} || ''' has another definition.' END", "''",
    f"CASE WHEN s.column_name IS NOT NULL THEN {sql.signature('s.')} END",
    f"CASE WHEN t.column_name IS NOT NULL THEN {sql.signature('t.')} END",
    rest=f"""FROM (SELECT * FROM s_columns WHERE table_name IN (SELECT table_name FROM t_tables)) s
FULL JOIN (SELECT * FROM t_columns WHERE table_name IN (SELECT table_name FROM s_tables)) t
  ON s.table_name = t.table_name AND s.column_name = t.column_name
WHERE s.column_name IS NULL OR t.column_name IS NULL OR {sql.signature('s.')} <> {sql.signature('t.')}""",
)


def _objects_sql(kind: str, stage: int, s: str, t: str) -> str:
    name = "coalesce(s.name, t.name)"
    return sql.diff(
        stage, f"'{kind}'", "CASE WHEN s.name IS NULL THEN 'MEDIUM' ELSE 'HIGH' END", _ST, name, "''",
        f"CASE WHEN t.name IS NULL THEN '''' || {name} || ''' exists in source and not in target.' "
        f"WHEN s.name IS NULL THEN '''' || {name} || ''' exists in target and not in source.' "
        f"ELSE '''' || {name} || ''' has another definition.' END", "''", "s.definition", "t.definition",
        rest=f"""FROM {s} s FULL JOIN {t} t ON s.table_name = t.table_name AND s.name = t.name
WHERE (s.name IS NULL OR t.name IS NULL OR s.sig <> t.sig)
  AND NOT (t.name IS NULL AND EXISTS (SELECT 1 FROM {t} o WHERE o.table_name = s.table_name AND o.sig = s.sig))
  AND NOT (s.name IS NULL AND EXISTS (SELECT 1 FROM {s} o WHERE o.table_name = t.table_name AND o.sig = t.sig))""",
    )


_OBJECTS = f"""
both_tables AS (SELECT table_name FROM s_tables INTERSECT SELECT table_name FROM t_tables),
s_con AS (SELECT table_name, constraint_name AS name, {sql.constraint_text('definition')} AS sig, definition FROM s_constraints
  WHERE constraint_type <> 'n' AND table_name IN (SELECT table_name FROM both_tables)),
t_con AS (SELECT table_name, constraint_name AS name, {sql.constraint_text('definition')} AS sig, definition FROM t_constraints
  WHERE constraint_type <> 'n' AND table_name IN (SELECT table_name FROM both_tables)),
s_idx AS (SELECT table_name, index_name AS name, indexdef AS sig, indexdef AS definition FROM s_indexes i
  WHERE table_name IN (SELECT table_name FROM both_tables)
  AND NOT EXISTS (SELECT 1 FROM s_con c WHERE c.table_name = i.table_name AND c.name = i.index_name)),
t_idx AS (SELECT table_name, index_name AS name, indexdef AS sig, indexdef AS definition FROM t_indexes i
  WHERE table_name IN (SELECT table_name FROM both_tables)
  AND NOT EXISTS (SELECT 1 FROM s_con c WHERE c.table_name = i.table_name AND c.name = i.index_name)
  AND NOT EXISTS (SELECT 1 FROM t_con c WHERE c.table_name = i.table_name AND c.name = i.index_name))"""
_STRUCTURE_KINDS = ("tables", "columns", "constraints", "indexes")


@register(
    "structure_compare",
    f"WITH {ctes(*_STRUCTURE_KINDS)}, {_OBJECTS}\n{STRUCT_COLUMNS}\nUNION ALL\n"
    f"{_objects_sql('CONSTRAINT_DIFFERENT', 3, 's_con', 't_con')}\nUNION ALL\n{_objects_sql('INDEX_DIFFERENT', 4, 's_idx', 't_idx')}",
)
def structure_compare(spark: SparkSession, folder: str) -> DataFrame:
    return structure.structure_diff(*catalogs(spark, folder, *_STRUCTURE_KINDS))


_TABLE_DDL = f"""
SELECT o.table_name, concat_ws(chr(10) || chr(10), {_CREATE}, k.body, i.body) AS ddl
FROM s_tables o LEFT JOIN {_CLAUSES} c ON c.table_name = o.table_name
LEFT JOIN (SELECT table_name, string_agg({sql.add_constraint("'public'", 'table_name', 'constraint_name', 'definition')},
  chr(10) || chr(10) ORDER BY constraint_name) AS body FROM s_constraints WHERE constraint_type <> 'n' GROUP BY table_name) k
  ON k.table_name = o.table_name
LEFT JOIN (SELECT x.table_name, string_agg(regexp_replace(x.indexdef, ';+$', '') || ';', chr(10) || chr(10) ORDER BY x.index_name) AS body
  FROM s_indexes x WHERE NOT EXISTS (SELECT 1 FROM s_constraints y WHERE y.constraint_type <> 'n' AND y.table_name = x.table_name
  AND y.constraint_name = x.index_name) GROUP BY x.table_name) i ON i.table_name = o.table_name"""


@register("table_ddl", with_ctes(_STRUCTURE_KINDS, _TABLE_DDL))
def table_ddl(spark: SparkSession, folder: str) -> DataFrame:
    return structure.table_ddl(catalogs(spark, folder, *_STRUCTURE_KINDS)[0])


def _plan_part(part: int, order: str, kind: str, name: str, text_sql: str, rest: str) -> str:
    return (
        f"SELECT s.table_name, {part} AS part, {order} AS pos, {kind} AS action, {name} AS object_name, {text_sql} AS sql {rest}"
    )


_ADD = sql.add_constraint("'public'", "s.table_name", "s.constraint_name", "s.definition")
_PROMOTED = (
    "(t.constraint_name IS NULL AND s.constraint_type IN ('p', 'u') AND EXISTS (SELECT 1 FROM t_indexes i "
    "WHERE i.table_name = s.table_name AND i.index_name = s.constraint_name))"
)
_USING = sql.add_constraint(
    "'public'", "s.table_name", "s.constraint_name",
    f"(CASE s.constraint_type WHEN 'p' THEN 'PRIMARY KEY' ELSE 'UNIQUE' END || ' USING INDEX ' || {sql.q('s.constraint_name')})",
)
_TABLES_IN_TARGET = "s.table_name IN (SELECT table_name FROM t_tables)"
_SYNC = "\nUNION ALL\n".join([
    _plan_part(0, "0", "'CREATE_TABLE'", "s.table_name", "s.ddl", f"FROM ({_TABLE_DDL}) s WHERE NOT {_TABLES_IN_TARGET}"),
    _plan_part(
        1, "s.ordinal_position", "CASE WHEN t.column_name IS NULL THEN 'ADD_COLUMN' ELSE 'ALTER_COLUMN' END", "s.column_name",
        f"CASE WHEN t.column_name IS NULL THEN 'ALTER TABLE ' || {_FULL} || ' ADD COLUMN ' || {sql.column_clause('s.')} || ';' "
        f"ELSE {sql.alter_column(_PUB, _SQ, 's.')} END",
        f"FROM s_columns s LEFT JOIN t_columns t ON s.table_name = t.table_name AND s.column_name = t.column_name "
        f"WHERE {_TABLES_IN_TARGET} AND (t.column_name IS NULL OR {sql.signature('s.')} <> {sql.signature('t.')})",
    ),
    _plan_part(
        2, "0",
        f"CASE WHEN {_PROMOTED} THEN 'PROMOTE_INDEX' WHEN t.constraint_name IS NULL THEN 'ADD_CONSTRAINT' ELSE 'REPLACE_CONSTRAINT' END",
        "s.constraint_name",
        f"CASE WHEN {_PROMOTED} THEN {_USING} WHEN t.constraint_name IS NULL THEN {_ADD} ELSE 'ALTER TABLE ' || {_FULL} "
        f"|| ' DROP CONSTRAINT ' || {sql.q('s.constraint_name')} || ';' || chr(10) || {_ADD} END",
        f"""FROM s_constraints s LEFT JOIN (SELECT * FROM t_constraints WHERE constraint_type <> 'n') t
  ON s.table_name = t.table_name AND s.constraint_name = t.constraint_name
WHERE s.constraint_type <> 'n' AND {_TABLES_IN_TARGET} AND ((t.constraint_name IS NULL AND NOT EXISTS (SELECT 1 FROM t_constraints o
  WHERE o.constraint_type <> 'n' AND o.table_name = s.table_name AND {sql.constraint_text('o.definition')} = {sql.constraint_text('s.definition')}))
  OR {sql.constraint_text('t.definition')} <> {sql.constraint_text('s.definition')})""",
    ),
    _plan_part(
        3, "0", "CASE WHEN t.index_name IS NULL THEN 'CREATE_INDEX' ELSE 'REPLACE_INDEX' END", "s.index_name",
        f"CASE WHEN t.index_name IS NULL THEN '' ELSE 'DROP INDEX ' || {sql.qual(_PUB, 's.index_name')} || ';' || chr(10) END "
        "|| regexp_replace(s.indexdef, ';+$', '') || ';'",
        f"""FROM s_indexes s LEFT JOIN (SELECT * FROM t_indexes x WHERE NOT EXISTS (SELECT 1 FROM t_constraints y WHERE y.constraint_type <> 'n'
    AND y.table_name = x.table_name AND y.constraint_name = x.index_name)) t
  ON s.table_name = t.table_name AND s.index_name = t.index_name
WHERE {_TABLES_IN_TARGET} AND s.index_name NOT IN (SELECT y.constraint_name FROM s_constraints y WHERE y.constraint_type <> 'n')
  AND (t.index_name IS NULL OR t.indexdef <> s.indexdef)""",
    ),
])


@register(
    "sync_plan",
    with_ctes(
        _STRUCTURE_KINDS,
        f"SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY part, pos, object_name) AS INT) AS seq, "
        f"action, object_name, sql FROM ({_SYNC}) p",
    ),
)
def sync_plan(spark: SparkSession, folder: str) -> DataFrame:
    return align.sync_plan(*catalogs(spark, folder, *_STRUCTURE_KINDS))


# --- rules, names, edges -------------------------------------------------------------------------

_RULES = """
all_rules AS (
  SELECT 'required' AS kind, column_name AS rule_name, table_name, [column_name] AS columns, '' AS parent, CAST([] AS VARCHAR[]) AS parent_columns,
    data_type IN ('character varying', 'character', 'text') AS text FROM s_columns WHERE is_nullable = 'NO'
  UNION ALL SELECT constraint_type, constraint_name, table_name, columns, coalesce(referenced_table, ''), coalesce(referenced_columns, []), FALSE
  FROM s_constraints WHERE constraint_type IN ('p', 'u', 'f')),
s_null AS (SELECT table_name, list(column_name) AS names FROM s_columns WHERE is_nullable = 'YES' GROUP BY table_name),
t_null AS (SELECT table_name, list(column_name) AS names FROM t_columns WHERE is_nullable = 'YES' GROUP BY table_name),
t_all AS (SELECT table_name, list(column_name) AS names FROM t_columns WHERE table_name IN (SELECT table_name FROM t_tables) GROUP BY table_name)
SELECT kind, rule_name, r.table_name, array_to_string(columns, ',') AS columns, parent, text,
  array_to_string(list_filter(columns, lambda x: list_contains(coalesce(sn.names, []), x)), ',') AS source_nullable,
  array_to_string(list_filter(columns, lambda x: list_contains(coalesce(tn.names, []), x)), ',') AS target_nullable,
  r.table_name IN (SELECT table_name FROM t_tables) AND list_has_all(coalesce(ta.names, []), columns) AS applicable,
  r.table_name IN (SELECT table_name FROM t_tables) AND list_has_all(coalesce(ta.names, []), columns)
    AND (kind <> 'f' OR list_has_all(coalesce(pa.names, []), parent_columns)) AS parent_applicable
FROM all_rules r LEFT JOIN s_null sn ON sn.table_name = r.table_name LEFT JOIN t_null tn ON tn.table_name = r.table_name
LEFT JOIN t_all ta ON ta.table_name = r.table_name LEFT JOIN t_all pa ON pa.table_name = r.parent"""
_RULE_KINDS = ("tables", "columns", "constraints")


@register("rules_applicable", f"WITH {ctes(*_RULE_KINDS)}, {_RULES}")
def rules_applicable(spark: SparkSession, folder: str) -> DataFrame:
    found = integrity.catalog_rules(*catalogs(spark, folder, *_RULE_KINDS))
    arrays = ("columns", "source_nullable", "target_nullable")
    return found.withColumns({n: F.array_join(n, ",") for n in arrays}).drop("parent_columns")


# Each customer's name is asked for in two spellings; every tenth table has a twin in capitals.
_KNOWN = (
    "SELECT 't' || CAST(c_custkey AS STRING) AS table_name, 'BASE TABLE' AS table_type FROM {customer} WHERE c_custkey % 7 <> 0 "
    "UNION ALL SELECT 'T' || CAST(c_custkey AS STRING), 'BASE TABLE' FROM {customer} WHERE c_custkey % 10 = 0"
)
_WANTED = (
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 't' ELSE 'T' END || CAST(o_custkey AS STRING) AS requested FROM {orders}"
)


@register(
    "resolve_table",
    f"""WITH known AS ({oracle(_KNOWN)}), wanted AS (SELECT DISTINCT requested FROM ({oracle(_WANTED)}) w),
matched AS (SELECT requested, (SELECT count(*) FROM known WHERE table_name = requested) AS exact,
  (SELECT count(*) FROM known WHERE lower(table_name) = lower(requested)) AS n,
  (SELECT min(table_name) FROM known WHERE lower(table_name) = lower(requested)) AS single FROM wanted)
SELECT requested, CASE WHEN exact > 0 THEN requested WHEN n = 1 THEN single END AS table_name,
  CASE WHEN exact > 0 OR n = 1 THEN 'OK' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS state FROM matched""",
)
def resolve_table(spark: SparkSession, folder: str) -> DataFrame:
    from tablecheck.model import Catalog

    known = Catalog.from_snapshot(spark, {"tables": frame(spark, folder, _KNOWN)}, env="")
    return resolve_tables(known, frame(spark, folder, _WANTED))


@register(
    "fk_edges",
    with_ctes(
        ("constraints",),
        "SELECT DISTINCT 'public' AS parent_schema, referenced_table AS parent_table, 'public' AS child_schema, table_name AS child_table "
        "FROM s_constraints WHERE constraint_type = 'f' AND referenced_table <> table_name",
    ),
)
def fk_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = purge.fk_edges(catalogs(spark, folder, "constraints")[0])
    return edges.select(
        F.col("parent.schema").alias("parent_schema"), F.col("parent.name").alias("parent_table"),
        F.col("child.schema").alias("child_schema"), F.col("child.name").alias("child_table"),
    )


# Customers as tables that refer to one or two customers of lower number, all leading to number 0.
_TREE = (
    "SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS p, c_custkey AS k FROM {customer} WHERE c_custkey > 0 "
    "UNION SELECT CAST(floor(c_custkey / 27) AS BIGINT), c_custkey FROM {customer} WHERE c_custkey > 0"
)


@register(
    "fk_edges_all_schemas",
    f"""WITH {raw_ctes("class", "namespace", "constraint")},
named AS (SELECT c.env, c.oid, n.nspname, c.relname FROM r_class c JOIN r_namespace n ON n.env = c.env AND n.oid = c.relnamespace)
SELECT DISTINCT p.nspname AS parent_schema, p.relname AS parent_table, c.nspname AS child_schema, c.relname AS child_table
FROM r_constraint k JOIN named c ON c.env = k.env AND c.oid = k.conrelid JOIN named p ON p.env = k.env AND p.oid = k.confrelid
WHERE k.contype = 'f' AND (p.nspname, p.relname) <> (c.nspname, c.relname)""",
)
def fk_edges_all_schemas(spark: SparkSession, folder: str) -> DataFrame:
    return _ends(purge.raw_fk_edges(raw(spark, folder, "class", "namespace", "constraint"), "a"))


def _ends(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(
        *more, F.col("parent.schema").alias("parent_schema"), F.col("parent.name").alias("parent_table"),
        F.col("child.schema").alias("child_schema"), F.col("child.name").alias("child_table"),
    )


# Raw rows of two other kinds of server: key usage with a row per column, and numbered objects.
MYSQL = {
    "key_column_usage": """
SELECT 'm' || CAST(o_orderkey % 2 AS STRING) AS env, 'shop' AS TABLE_SCHEMA, 't' || CAST(o_orderkey AS STRING) AS TABLE_NAME,
  CASE WHEN o_orderkey % 3 <> 1 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'crm' ELSE 'shop' END END AS REFERENCED_TABLE_SCHEMA,
  CASE WHEN o_orderkey % 3 <> 1 THEN 't' || CAST(o_custkey AS STRING) END AS REFERENCED_TABLE_NAME, 'c' || CAST(l_linenumber AS STRING) AS COLUMN_NAME
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
}
SQLSERVER = {
    "foreign_keys": "SELECT 's' AS env, o_orderkey AS parent_object_id, o_custkey AS referenced_object_id FROM {orders} WHERE o_orderkey % 5 <> 0",
    "tables": "SELECT 's' AS env, o_orderkey AS object_id, CAST(o_orderkey % 4 AS BIGINT) AS schema_id, 't' || CAST(o_orderkey AS STRING) AS name FROM {orders}",
    "schemas": "SELECT 's' AS env, CAST(n_nationkey AS BIGINT) AS schema_id, lower(n_name) AS name FROM {nation} WHERE n_nationkey % 4 <> 3",
}


def _engines_sql() -> str:
    return f"""WITH {raw_ctes("class", "namespace", "constraint")}, usage AS ({oracle(MYSQL["key_column_usage"])}),
fk AS ({oracle(SQLSERVER["foreign_keys"])}), tab AS ({oracle(SQLSERVER["tables"])}), spc AS ({oracle(SQLSERVER["schemas"])}),
named AS (SELECT c.env, c.oid, n.nspname, c.relname FROM r_class c JOIN r_namespace n ON n.env = c.env AND n.oid = c.relnamespace),
found AS (
SELECT 'postgresql' AS engine, k.env, p.nspname AS parent_schema, p.relname AS parent_table, c.nspname AS child_schema, c.relname AS child_table
FROM r_constraint k JOIN named c ON c.env = k.env AND c.oid = k.conrelid JOIN named p ON p.env = k.env AND p.oid = k.confrelid WHERE k.contype = 'f'
UNION SELECT 'mysql', env, REFERENCED_TABLE_SCHEMA, REFERENCED_TABLE_NAME, TABLE_SCHEMA, TABLE_NAME FROM usage WHERE REFERENCED_TABLE_NAME IS NOT NULL
UNION SELECT 'sqlserver', f.env, ps.name, p.name, cs.name, c.name FROM fk f JOIN tab c ON c.object_id = f.parent_object_id
JOIN spc cs ON cs.schema_id = c.schema_id JOIN tab p ON p.object_id = f.referenced_object_id JOIN spc ps ON ps.schema_id = p.schema_id)
SELECT * FROM found WHERE parent_schema <> child_schema OR parent_table <> child_table"""


@register("fk_edges_engines", _engines_sql())
def fk_edges_engines(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign-key pairs of servers of three kinds, each from its raw rows."""
    loaded: dict[str, DataFrame] = {}
    servers = {engine: {n: frame(spark, folder, text, loaded) for n, text in parts.items()} for engine, parts in (("mysql", MYSQL), ("sqlserver", SQLSERVER))}
    servers["postgresql"] = raw(spark, folder, "class", "namespace", "constraint")
    return _ends(purge.engine_edges(servers), "engine", "env")


# A tree over the customers, with rings of three, knots of two rings, and longer rings put in.
KNOTS = (
    "SELECT CAST(floor(c_custkey / 8) AS BIGINT) AS p, c_custkey AS k FROM {customer} WHERE c_custkey > 0 "
    "UNION SELECT c_custkey, c_custkey + 1 FROM {customer} WHERE c_custkey % 40 IN (30, 31) "
    "UNION SELECT c_custkey + 2, c_custkey FROM {customer} WHERE c_custkey % 40 = 30 "
    "UNION SELECT c_custkey + 1, c_custkey + 2 FROM {customer} WHERE c_custkey % 80 = 30 "
    "UNION SELECT c_custkey + 3, c_custkey + 1 FROM {customer} WHERE c_custkey % 80 = 30 "
    "UNION SELECT c_custkey + 1, c_custkey + 3 FROM {customer} WHERE c_custkey % 80 = 30 "
    "UNION SELECT c_custkey, c_custkey + 1 FROM {customer} WHERE c_custkey % 100 BETWEEN 5 AND 13 "
    "UNION SELECT c_custkey + 9, c_custkey FROM {customer} WHERE c_custkey % 100 = 5"
)


@register(
    "fk_components",
    f"""WITH RECURSIVE e AS ({oracle(KNOTS)}), reach(a, b) AS (SELECT p, k FROM e WHERE p <> k UNION SELECT r.a, e.k FROM reach r JOIN e ON e.p = r.b)
SELECT min('g' || CAST(y.b AS VARCHAR)) AS component, 'g' || CAST(x.a AS VARCHAR) AS table_name FROM reach x JOIN reach y ON x.a = y.a
JOIN reach z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a""",
)
def fk_components(spark: SparkSession, folder: str) -> DataFrame:
    """Every component of a graph of foreign keys with cycles put in."""
    ref = "named_struct('schema', 'public', 'name', concat('g', CAST({} AS STRING)))"
    edges = frame(spark, folder, KNOTS).selectExpr(f"{ref.format('p')} AS parent", f"{ref.format('k')} AS child")
    return graph.components(edges).select(F.col("component.name").alias("component"), F.col("table.name").alias("table_name"))


@register(
    "fk_closure",
    f"""WITH RECURSIVE edges AS ({oracle(_TREE)}),
walk AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth UNION SELECT e.k, w.depth + 1 FROM walk w JOIN edges e ON e.p = w.k)
SELECT 'public' AS schema, 't' || k AS name, max(depth) AS depth FROM walk GROUP BY k""",
)
def fk_closure(spark: SparkSession, folder: str) -> DataFrame:
    def ref(key: str):
        return F.struct(F.lit("public").alias("schema"), F.concat(F.lit("t"), F.col(key).cast("string")).alias("name"))

    edges = frame(spark, folder, _TREE).select(ref("p").alias("parent"), ref("k").alias("child"))
    return purge.closure(edges, purge.TableRef("public", "t0")).select("table.schema", "table.name", "depth")


# --- assembly from raw system tables ---------------------------------------------------------------

_CLASS = "r_class JOIN r_namespace ns ON ns.env = r_class.env AND ns.oid = r_class.relnamespace AND ns.nspname = 'public'"
_CLS = f"cls AS (SELECT r_class.*, ns.nspname FROM {_CLASS})"


def raw_query(name: str, parts: tuple[str, ...], body: str, build, arrays: tuple[str, ...] = ()):
    ORACLES[name] = f"WITH {raw_ctes(*parts)}{', ' if not body.lstrip().startswith('SELECT') else ''}{body}"

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return build(raw(spark, folder, *parts)).withColumns({a: F.array_join(a, ",") for a in arrays})

    QUERIES[name] = query


raw_query(
    "catalog_columns", ("namespace", "class", "attribute", "type", "attrdef", "collation", "info_columns"),
    f"""{_CLS}
SELECT a.env, c.relname AS table_name, a.attname AS column_name, a.attnum AS ordinal_position, d.expression AS column_default,
  CASE WHEN a.attnotnull THEN 'NO' ELSE 'YES' END AS is_nullable, coalesce(i.data_type, a.formatted_type) AS data_type,
  t.typname AS udt_name, i.character_maximum_length, i.numeric_precision, i.numeric_scale, i.datetime_precision,
  a.attidentity AS identity_kind, CASE a.attidentity WHEN 'a' THEN 'ALWAYS' WHEN 'd' THEN 'BY DEFAULT' ELSE '' END AS identity_generation,
  a.attgenerated AS generated_kind, CASE WHEN a.attgenerated = 's' THEN d.expression END AS generation_expression,
  l.collname AS collation_name, a.comment, a.formatted_type
FROM r_attribute a JOIN cls c ON c.env = a.env AND c.oid = a.attrelid AND c.relkind IN ('r', 'p')
JOIN r_type t ON t.env = a.env AND t.oid = a.atttypid
LEFT JOIN r_attrdef d ON d.env = a.env AND d.adrelid = a.attrelid AND d.adnum = a.attnum
LEFT JOIN r_collation l ON l.env = a.env AND l.oid = a.attcollation AND a.attcollation <> t.typcollation
LEFT JOIN r_info_columns i ON i.env = a.env AND i.table_schema = c.nspname AND i.table_name = c.relname AND i.column_name = a.attname
WHERE a.attnum > 0 AND NOT a.attisdropped""",
    lambda r: builders.build_columns(r, "public"),
)


def _names(key: str, relation: str) -> str:
    return (
        f"(SELECT x.env, x.oid, string_agg(a.attname, ',' ORDER BY x.pos) AS names FROM (SELECT env, oid, {relation} AS rel, "
        f"unnest({key}) AS num, generate_subscripts({key}, 1) AS pos FROM r_constraint) x "
        "JOIN r_attribute a ON a.env = x.env AND a.attrelid = x.rel AND a.attnum = x.num GROUP BY x.env, x.oid)"
    )


raw_query(
    "catalog_constraints", ("namespace", "class", "attribute", "constraint"),
    f"""{_CLS}
SELECT k.env, k.conname AS constraint_name, c.relname AS table_name, k.contype AS constraint_type, k.definition,
  k.condeferrable AS deferrable, k.condeferred AS initially_deferred, k.confupdtype AS on_update, k.confdeltype AS on_delete,
  pn.nspname AS referenced_schema, coalesce(n.names, '') AS columns, p.relname AS referenced_table,
  coalesce(f.names, '') AS referenced_columns
FROM r_constraint k JOIN cls c ON c.env = k.env AND c.oid = k.conrelid
LEFT JOIN r_class p ON p.env = k.env AND p.oid = k.confrelid LEFT JOIN r_namespace pn ON pn.env = p.env AND pn.oid = p.relnamespace
LEFT JOIN {_names('conkey', 'conrelid')} n ON n.env = k.env AND n.oid = k.oid
LEFT JOIN {_names('confkey', 'confrelid')} f ON f.env = k.env AND f.oid = k.oid""",
    lambda r: builders.build_constraints(r, "public"), ("columns", "referenced_columns"),
)

raw_query(
    "catalog_indexes", ("namespace", "class", "attribute", "index", "opclass", "am"),
    f"""{_CLS},
keys AS (SELECT env, indexrelid, indrelid, unnest(indkey) AS num, generate_subscripts(indkey, 1) AS pos FROM r_index),
classes AS (SELECT env, indexrelid, unnest(indclass) AS num, generate_subscripts(indclass, 1) AS pos FROM r_index)
SELECT x.env, t.nspname AS schema_name, t.relname AS table_name, i.relname AS index_name, i.indexdef, m.amname AS method,
  x.indisunique AS is_unique, x.indisprimary AS is_primary, x.predicate, x.expressions,
  coalesce((SELECT string_agg(a.attname, ',' ORDER BY k.pos) FROM keys k JOIN r_attribute a ON a.attrelid = k.indrelid AND a.attnum = k.num
    WHERE k.num > 0 AND k.indexrelid = x.indexrelid), '') AS columns,
  coalesce((SELECT string_agg(o.opcname, ',' ORDER BY k.pos) FROM classes k JOIN r_opclass o ON o.oid = k.num
    WHERE k.indexrelid = x.indexrelid), '') AS opclasses, i.comment
FROM r_index x JOIN cls t ON t.env = x.env AND t.oid = x.indrelid JOIN r_class i ON i.env = x.env AND i.oid = x.indexrelid
JOIN r_am m ON m.env = x.env AND m.oid = i.relam""",
    lambda r: builders.build_indexes(r, "public"), ("columns", "opclasses"),
)

raw_query(
    "catalog_schemas", ("namespace",), "SELECT env, nspname AS schema_name FROM r_namespace WHERE nspname = 'public'",
    lambda r: builders.build_schemas(r, "public"),
)
raw_query(
    "catalog_tables", ("namespace", "class"),
    f"{_CLS} SELECT env, relname AS table_name, 'BASE TABLE' AS table_type FROM cls WHERE relkind IN ('r', 'p')",
    lambda r: builders.build_tables(r, "public"),
)
for _name, _kind in (("catalog_views", "v"), ("catalog_matviews", "m")):
    raw_query(
        _name, ("namespace", "class"),
        f"{_CLS} SELECT env, relname AS view_name, viewdef AS view_definition, comment FROM cls WHERE relkind = '{_kind}'",
        lambda r, kind=_kind: builders.build_views(r, "public", kind),
    )
raw_query(
    "catalog_sequences", ("namespace", "class", "attribute", "sequence", "depend"),
    f"""{_CLS}
SELECT s.env, c.relname AS sequence_name, s.data_type, s.seqstart AS start_value, s.seqmin AS minimum_value, s.seqmax AS maximum_value,
  s.seqincrement AS increment, s.seqcache AS cache_size, s.seqcycle AS cycle, o.relname AS owner_table, a.attname AS owner_column
FROM r_sequence s JOIN cls c ON c.env = s.env AND c.oid = s.seqrelid
LEFT JOIN r_depend d ON d.env = s.env AND d.objid = c.oid AND d.deptype IN ('a', 'i')
LEFT JOIN r_class o ON o.env = s.env AND o.oid = d.refobjid
LEFT JOIN r_attribute a ON a.env = s.env AND a.attrelid = d.refobjid AND a.attnum = d.refobjsubid""",
    lambda r: builders.build_sequences(r, "public"),
)
raw_query(
    "catalog_functions", ("namespace", "proc", "language"),
    """SELECT p.env, n.nspname AS schema_name, p.proname AS function_name, p.identity_arguments, p.arguments, p.return_type,
  l.lanname AS language, p.definition, p.volatility, p.prosecdef AS security_definer, p.proisstrict AS strict_null_input, p.comment
FROM r_proc p JOIN r_namespace n ON n.env = p.env AND n.oid = p.pronamespace JOIN r_language l ON l.env = p.env AND l.oid = p.prolang
WHERE n.nspname = 'public'""",
    lambda r: builders.build_functions(r, "public"),
)
raw_query(
    "catalog_extensions", ("namespace", "extension"),
    """SELECT x.env, x.extname AS extension_name, x.extversion AS version, n.nspname AS schema_name
FROM r_extension x JOIN r_namespace n ON n.env = x.env AND n.oid = x.extnamespace""",
    lambda r: builders.build_extensions(r),
)
raw_query(
    "catalog_triggers", ("namespace", "class", "proc", "trigger"),
    f"""{_CLS}
SELECT t.env, c.relname AS table_name, t.tgname AS trigger_name, t.definition, t.tgenabled AS enabled, n.nspname AS function_schema,
  p.proname AS function_name, p.identity_arguments AS function_arguments
FROM r_trigger t JOIN cls c ON c.env = t.env AND c.oid = t.tgrelid JOIN r_proc p ON p.env = t.env AND p.oid = t.tgfoid
JOIN r_namespace n ON n.env = p.env AND n.oid = p.pronamespace WHERE NOT t.tgisinternal""",
    lambda r: builders.build_triggers(r, "public"),
)


# --- text functions --------------------------------------------------------------------------------


@register(
    "normalize_sql",
    with_ctes(
        ("views", "columns"),
        f"SELECT 'v' AS kind, view_name AS name, {sql.norm('view_definition')} AS normalized FROM t_views "
        f"UNION ALL SELECT 'c', table_name || '.' || column_name, {sql.norm('column_default')} FROM t_columns",
    ),
)
def normalize_sql(spark: SparkSession, folder: str) -> DataFrame:
    target = catalogs(spark, folder, "views", "columns")[1]
    views = target.views.select(
        F.lit("v").alias("kind"), F.col("view_name").alias("name"),
        text.normalize_sql("view_definition").alias("normalized"),
    )
    return views.unionByName(
        target.columns.select(
            F.lit("c").alias("kind"), F.concat_ws(".", "table_name", "column_name").alias("name"),
            text.normalize_sql("column_default").alias("normalized"),
        )
    )


# Part names with characters that each engine has to double.
_ODD = "SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '\"' WHEN 1 THEN '`' WHEN 2 THEN ']' ELSE '''' END || p_brand AS name FROM {part}"


@register(
    "quote_identifiers",
    f"""SELECT p_partkey, '"' || replace(name, '"', '""') || '"' AS postgresql, '`' || replace(name, '`', '``') || '`' AS mysql,
  '[' || replace(name, ']', ']]') || ']' AS sqlserver, '"public"."' || replace(name, '"', '""') || '"' AS qualified,
  '''' || replace(name, '''', '''''') || '''' AS literal FROM ({oracle(_ODD)}) x""",
)
def quote_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("name")
    return frame(spark, folder, _ODD).select(
        "p_partkey", *[text.quote_ident(name, e).alias(e) for e in ("postgresql", "mysql", "sqlserver")],
        text.qualify(F.lit("public"), name).alias("qualified"), text.sql_literal(name).alias("literal"),
    )


@register(
    "type_text",
    with_ctes(
        ("columns",),
        f"SELECT table_name, column_name, {sql.type_text('')} AS type, {sql.column_clause('')} AS clause FROM s_columns",
    ),
)
def type_text(spark: SparkSession, folder: str) -> DataFrame:
    source = catalogs(spark, folder, "columns")[0]
    return source.columns.select(
        "table_name", "column_name", ddl.type_text().alias("type"), ddl.column_clause().alias("clause")
    )


@register(
    "constraint_text",
    with_ctes(
        ("constraints",),
        f"SELECT constraint_name, {sql.constraint_text('definition')} AS sig FROM t_constraints",
    ),
)
def constraint_text(spark: SparkSession, folder: str) -> DataFrame:
    target = catalogs(spark, folder, "constraints")[1]
    return target.constraints.select("constraint_name", text.constraint_text(F.col("definition")).alias("sig"))


# --- summaries and scripts -------------------------------------------------------------------------

_LEVELS = "(VALUES (1, 'CRITICAL'), (2, 'HIGH'), (3, 'MEDIUM'), (4, 'LOW')) l(impact_rank, impact)"


@register(
    "summary_by_impact",
    with_ctes(
        tuple(SNAPSHOT),
        f"SELECT l.impact_rank, l.impact, count(d.impact) AS n FROM {_LEVELS} LEFT JOIN ({ALL_DRIFT}) d ON d.impact = l.impact GROUP BY 1, 2",
    ),
)
def summary_by_impact(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary_by_impact(drift_run(spark, folder))


@register("summary_by_type", with_ctes(tuple(SNAPSHOT), f"SELECT type, count(*) AS n FROM ({ALL_DRIFT}) d GROUP BY type"))
def summary_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary_by_type(drift_run(spark, folder))


_NUMBERED = f"""
SELECT row_number() OVER (ORDER BY impact_rank, stage, object_table, object_name) AS number, * FROM ({ALL_DRIFT}) d"""


@register("numbered_detail", with_ctes(tuple(SNAPSHOT), f"SELECT number, type, impact, object_table, object_name, description FROM ({_NUMBERED}) n"))
def numbered_detail(spark: SparkSession, folder: str) -> DataFrame:
    shown = ("type", "impact", "object_table", "object_name", "description")
    # Statements and definitions are neither made nor sorted for a list that does not show them.
    wanted = drift_run(spark, folder).select(*shown, *[c for c in report.DIFF_ORDER if c not in shown])
    return report.numbered(wanted).select("number", *shown)


def _commented(x: str) -> str:
    return f"CASE WHEN {sql.e(x)} = '' THEN '-- (absent or not available)' ELSE '-- ' || replace({x}, chr(10), chr(10) || '-- ') END"


_HEADER = "'" + "' || chr(10) || '".join(report.SCRIPT_HEADER) + "'"


@register(
    "script_rows",
    with_ctes(
        tuple(SNAPSHOT),
        f"""SELECT l.impact, CAST(0 AS BIGINT) AS position, {_HEADER} AS value FROM {_LEVELS} UNION ALL
SELECT impact, n, '-- ' || n || '. ' || type || chr(10) || '-- Impact: ' || impact || chr(10) || '-- Reason: ' || impact_reason || chr(10)
  || '-- ' || description || chr(10) || '-- Source definition:' || chr(10) || {_commented('source_definition')} || chr(10)
  || '-- Target definition:' || chr(10) || {_commented('target_definition')} || chr(10) || '-- Suggested change:' || chr(10)
  || regexp_replace(sql, '\\s+$', '') || chr(10)
FROM (SELECT *, row_number() OVER (PARTITION BY impact ORDER BY stage, object_table, object_name) AS n
  FROM ({ALL_DRIFT}) d) x""",
    ),
)
def script_rows(spark: SparkSession, folder: str) -> DataFrame:
    return report.script_rows(report.numbered(drift_run(spark, folder)))


@register(
    "difference_report",
    with_ctes(
        tuple(SNAPSHOT),
        f"""SELECT number, number || '. [' || impact || '] ' || type || chr(10) || '   ' || description || chr(10) || '   Reason: ' || impact_reason
  || chr(10) || '   Source definition:' || chr(10) || '   ' || CASE WHEN source_definition = '' THEN '(not available)' ELSE source_definition END
  || chr(10) || '   Target definition:' || chr(10) || '   ' || CASE WHEN target_definition = '' THEN '(absent or not available)' ELSE target_definition END
  || chr(10) || '   Suggested script:' || chr(10) || '   ' || trim(sql, ' ') || chr(10) AS value
FROM (SELECT *, row_number() OVER (ORDER BY impact_rank, stage, object_table, object_name) AS number FROM ({ALL_DRIFT}) d) x""",
    ),
)
def difference_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = report.numbered(drift_run(spark, folder))
    return rows.select("number", report.difference_text(F.col("number")).alias("value"))
