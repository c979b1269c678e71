"""Catalog snapshots and raw system tables derived from the sample tables.

Each order stands for a table, each order line for a column, each part for a view or a function, and
so on, so the snapshots grow with the sample tables. They are written in SQL that Spark and DuckDB
both accept; ``{orders}`` and the like stand for the sample tables and ``{ints}`` / ``{longs}`` for the
engine's spelling of integer arrays. The target side loses, alters and renames objects by rules on keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tablecheck.model import CATALOG_DDL, Catalog


def _str(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


# One row per (order, line number); order lines repeat numbers, so they are grouped. The flags are
# single letters, taken by code since Spark aggregates numbers by hash and texts by sorting.
LINES = (
    "(SELECT l_orderkey AS tk, l_linenumber AS ck, min(l_partkey) AS pk, min(l_suppkey) AS sk, "
    "CAST(min(l_quantity) AS INT) AS q, chr(min(ascii(l_returnflag))) AS rf, chr(min(ascii(l_linestatus))) AS ls "
    "FROM {lineitem} GROUP BY l_orderkey, l_linenumber) lines"
)


def tables(target: bool) -> str:
    lost = " WHERE o_orderkey % 97 <> 0" if target else ""
    return f"SELECT 't' || {_str('o_orderkey')} AS table_name, 'BASE TABLE' AS table_type FROM {{orders}}{lost}"


def columns(target: bool) -> str:
    nullable = "sk % 3 = 0"
    generated = "pk % 19 = 0"
    default = "now()"
    where = ""
    if target:
        nullable = "(sk % 3 = 0) <> (pk % 11 = 0)"
        generated = "pk % 19 = 0 AND pk % 38 <> 0"
        default = " NOW() ;"
        where = " WHERE tk % 97 <> 0 AND pk % 13 <> 0"
    out = f"""
SELECT 't' || {_str('tk')} AS table_name, 'c' || {_str('ck')} AS column_name, CAST(ck AS INT) AS ordinal_position,
  CASE WHEN pk % 5 = 0 THEN '{default}' WHEN pk % 5 = 1 THEN '''' || rf || '''::text' END AS column_default,
  CASE WHEN {nullable} THEN 'YES' ELSE 'NO' END AS is_nullable,
  CASE pk % 9 WHEN 0 THEN 'character varying' WHEN 1 THEN 'character' WHEN 2 THEN 'numeric'
    WHEN 3 THEN 'timestamp without time zone' WHEN 4 THEN 'timestamp with time zone' WHEN 5 THEN 'USER-DEFINED'
    WHEN 6 THEN 'ARRAY' WHEN 7 THEN 'text' ELSE 'integer' END AS data_type,
  CASE pk % 9 WHEN 5 THEN 'mood"' || rf WHEN 6 THEN '_int4_' ELSE 'x' END AS udt_name,
  CASE WHEN pk % 9 IN (0, 1) AND sk % 5 <> 0 THEN q END AS character_maximum_length,
  CASE WHEN pk % 9 = 2 AND sk % 2 = 0 THEN q + 5 END AS numeric_precision,
  CASE WHEN pk % 9 = 2 AND sk % 4 = 0 THEN 2 END AS numeric_scale, CAST(NULL AS INT) AS datetime_precision,
  CASE pk % 23 WHEN 0 THEN 'a' WHEN 1 THEN 'd' ELSE '' END AS identity_kind,
  CASE pk % 23 WHEN 0 THEN 'ALWAYS' WHEN 1 THEN 'BY DEFAULT' ELSE '' END AS identity_generation,
  CASE WHEN {generated} THEN 's' ELSE '' END AS generated_kind,
  CASE WHEN {generated} THEN 'c1 || ''' || ls || '''' END AS generation_expression,
  CASE WHEN pk % 17 = 0 THEN 'C' END AS collation_name,
  CASE WHEN pk % 7 = 0 THEN 'it''s ' || rf END AS comment,
  CASE WHEN sk % 4 = 1 THEN 'text' END AS formatted_type
FROM {LINES}{where}"""
    return out


def _constraint(name, kind, definition, columns, on_delete="NULL", parent="NULL", parent_columns="", deferrable="FALSE") -> str:
    key = f"split('{columns}', ',')" if columns else "NULL"
    referenced = f"split('{parent_columns}', ',')" if parent_columns else "NULL"
    schema = "NULL" if parent == "NULL" else "'public'"
    return (
        f"SELECT {name} AS constraint_name, 't' || {_str('o_orderkey')} AS table_name, '{kind}' AS constraint_type, "
        f"{definition} AS definition, {deferrable} AS deferrable, FALSE AS initially_deferred, "
        f"CASE WHEN '{kind}' = 'f' THEN 'a' END AS on_update, CAST({on_delete} AS STRING) AS on_delete, "
        f"CAST({schema} AS STRING) AS referenced_schema, CAST({key} AS {{strings}}) AS columns, "
        f"CAST({parent} AS STRING) AS referenced_table, CAST({referenced} AS {{strings}}) AS referenced_columns FROM {{orders}}"
    )


def constraints(target: bool) -> str:
    table = f"'t' || {_str('o_orderkey')}"
    parent = f"'t' || {_str('o_custkey')}"
    here = "o_orderkey % 97 <> 0" if target else "TRUE"
    fk_name = f"CASE WHEN o_orderkey % 7 = 0 THEN {table} || '_fk2' ELSE {table} || '_fk' END" if target else f"{table} || '_fk'"
    on_delete = "substr(o_orderpriority, 1, 1)"
    check = f"'CHECK (c1 > ' || {_str('o_custkey')} || ')'"
    unique_columns = "c4"
    if target:
        on_delete = f"CASE WHEN o_orderkey % 29 = 0 THEN 'z' ELSE {on_delete} END"
        check = (
            f"CASE WHEN o_orderkey % 41 = 0 THEN 'CHECK (c1 > 0)' WHEN o_orderkey % 3 = 0 THEN upper({check}) || ' ;' "
            f"ELSE {check} END"
        )
    action = f"' ON DELETE ' || {on_delete}"
    fk = f"'FOREIGN KEY (c2, c3) REFERENCES ' || {parent} || '(c1, c2)' || {action}"
    parts = [
        _constraint(f"{table} || '_pkey'", "p", "'PRIMARY KEY (c1)'", "c1")
        + f" WHERE {here}" + (" AND o_orderkey % 31 <> 0" if target else ""),
        _constraint(fk_name, "f", fk, "c2,c3", on_delete, parent, "c1,c2") + f" WHERE {here}",
        _constraint(f"{table} || '_c4_key'", "u", "'UNIQUE (c4)'", unique_columns)
        + f" WHERE {here} AND o_orderkey % 2 = 0" + (" AND o_orderkey % 37 <> 0" if target else ""),
        _constraint(f"{table} || '_check'", "c", check, "c1", deferrable="o_orderkey % 4 = 0")
        + f" WHERE {here} AND o_orderstatus = 'F'",
        _constraint(f"{table} || '_c1_not_null'", "n", "'NOT NULL c1'", "c1")
        + f" WHERE {here}" + (" AND o_orderkey % 5 <> 0" if target else ""),
    ]
    if target:
        parts.append(
            _constraint(f"{table} || '_extra'", "c", "'CHECK (c2 IS NOT NULL)'", "c2") + f" WHERE {here} AND o_orderkey % 53 = 0"
        )
    return "\nUNION ALL ".join(parts)


def indexes(target: bool) -> str:
    table = f"'t' || {_str('o_orderkey')}"
    here = "o_orderkey % 97 <> 0" if target else "TRUE"
    method = "CASE WHEN o_orderstatus = 'P' THEN 'gin' ELSE 'btree' END"
    if target:
        method = f"CASE WHEN o_orderkey % 47 = 0 THEN 'hash' ELSE {method} END"
    opclass = "CASE WHEN o_orderstatus = 'P' THEN 'gin_trgm_ops' ELSE 'text_ops' END"
    predicate = "CASE WHEN o_orderkey % 5 = 0 THEN 'c2 > 0' END"
    expression = "CASE WHEN o_orderkey % 6 = 0 THEN 'lower(c2)' END"
    definition = (
        f"'CREATE INDEX ' || {table} || '_c2_idx ON \"public\".' || {table} || ' USING ' || {method} || ' ('"
        f" || coalesce({expression}, 'c2') || ' ' || {opclass} || ')' || coalesce(' WHERE ' || {predicate}, '')"
    )

    def index(name, text, how, unique, primary, where, expr, key, ops) -> str:
        return (
            f"SELECT 'public' AS schema_name, {table} AS table_name, {name} AS index_name, {text} AS indexdef, {how} AS method, "
            f"{unique} AS is_unique, {primary} AS is_primary, CAST({where} AS STRING) AS predicate, "
            f"CAST({expr} AS STRING) AS expressions, split({key}, ',') AS columns, split({ops}, ',') AS opclasses, "
            "CAST(NULL AS STRING) AS comment FROM {orders}"
        )

    own = index(
        f"{table} || '_c2_idx'", definition, method, "FALSE", "FALSE", predicate, expression, "'c2'", opclass
    ) + f" WHERE {here}" + (" AND o_orderkey % 43 <> 0" if target else "")
    backing = f"'CREATE UNIQUE INDEX ' || {table} || '_pkey ON \"public\".' || {table} || ' USING btree (c1)'"
    key = index(f"{table} || '_pkey'", backing, "'btree'", "TRUE", "TRUE", "NULL", "NULL", "'c1'", "'text_ops'")
    key += f" WHERE {here}" + (" AND o_orderkey % 31 <> 0" if target else "")
    parts = [own, key]
    if target:
        stand_in = f"'CREATE UNIQUE INDEX ' || {table} || '_uix ON \"public\".' || {table} || ' USING btree (c1)'"
        parts.append(
            index(f"{table} || '_uix'", stand_in, "'btree'", "TRUE", "FALSE", "NULL", "NULL", "'c1'", "'text_ops'")
            + f" WHERE {here} AND o_orderkey % 62 = 0"
        )
        promoted = f"'CREATE UNIQUE INDEX ' || {table} || '_c4_key ON \"public\".' || {table} || ' USING btree (c4)'"
        parts.append(
            index(f"{table} || '_c4_key'", promoted, "'btree'", "TRUE", "FALSE", "NULL", "NULL", "'c4'", "'text_ops'")
            + f" WHERE {here} AND o_orderkey % 74 = 0"
        )
    return "\nUNION ALL ".join(parts)


def views(target: bool) -> str:
    body = "' SELECT ''' || p_name || '''  AS n,' || chr(10) || '  ' || p_brand || ' FROM x '"
    where = ""
    if target:
        body = f"CASE WHEN p_partkey % 17 = 0 THEN 'SELECT 1' WHEN p_partkey % 2 = 0 THEN upper({body}) || '; ' ELSE {body} END"
        where = " WHERE p_partkey % 13 <> 0"
    return f"SELECT 'v' || {_str('p_partkey')} AS view_name, {body} AS view_definition, CAST(NULL AS STRING) AS comment FROM {{part}}{where}"


def matviews(target: bool) -> str:
    body = "'SELECT ' || s_name || ' FROM y;'"
    where = ""
    if target:
        body = f"CASE WHEN s_suppkey % 7 = 0 THEN 'SELECT 2' ELSE {body} END"
        where = " WHERE s_suppkey % 9 <> 0"
    return f"SELECT 'm' || {_str('s_suppkey')} AS view_name, {body} AS view_definition, CAST(NULL AS STRING) AS comment FROM {{supplier}}{where}"


def sequences(target: bool) -> str:
    step, where = "c_nationkey % 3 + 1", ""
    if target:
        step, where = f"CASE WHEN c_custkey % 19 = 0 THEN 99 ELSE {step} END", " WHERE c_custkey % 23 <> 0"
    return (
        f"SELECT 'seq' || {_str('c_custkey')} AS sequence_name, 'bigint' AS data_type, CAST(c_custkey AS BIGINT) AS start_value, "
        f"CAST(1 AS BIGINT) AS minimum_value, CAST(c_custkey + 1000 AS BIGINT) AS maximum_value, CAST({step} AS BIGINT) AS increment, "
        f"CAST(1 AS BIGINT) AS cache_size, c_nationkey % 2 = 0 AS cycle, "
        f"CASE WHEN c_custkey % 4 = 0 THEN 't' || {_str('c_custkey')} END AS owner_table, "
        f"CASE WHEN c_custkey % 4 = 0 THEN 'c1' END AS owner_column FROM {{customer}}{where}"
    )


def functions(target: bool) -> str:
    body = "'CREATE FUNCTION f() AS ' || chr(10) || ' SELECT ' || CASE WHEN p_size = 7 THEN 'soundex(' ELSE '(' END || p_type || ')  '"
    volatility, where = "CASE WHEN p_size > 25 THEN 'i' ELSE 'v' END", ""
    if target:
        volatility = f"CASE WHEN p_partkey % 29 = 0 THEN 's' ELSE {volatility} END"
        where = " WHERE p_partkey % 31 <> 0"
        body = f"CASE WHEN p_partkey % 3 = 0 THEN lower({body}) ELSE {body} END"
    return (
        f"SELECT 'public' AS schema_name, 'f' || {_str('p_size')} AS function_name, 'a' || {_str('p_partkey')} || ' integer' "
        f"AS identity_arguments, 'a integer' AS arguments, p_brand AS return_type, 'sql' AS language, {body} AS definition, "
        f"{volatility} AS volatility, p_size % 2 = 0 AS security_definer, FALSE AS strict_null_input, "
        f"CAST(NULL AS STRING) AS comment FROM {{part}}{where}"
    )


def extensions(target: bool) -> str:
    where = " WHERE c_nationkey % 5 <> 0" if target else ""
    return (
        f"SELECT DISTINCT 'ext' || {_str('c_nationkey')} AS extension_name, '1.0' AS version, 'public' AS schema_name "
        f"FROM {{customer}}{where}"
    )


def schemas(target: bool) -> str:
    where = " WHERE c_nationkey % 4 <> 0" if target else ""
    return f"SELECT DISTINCT 'n\"' || {_str('c_nationkey')} AS schema_name FROM {{customer}}{where}"


def triggers(target: bool) -> str:
    enabled, where = "'O'", ""
    if target:
        enabled, where = "CASE WHEN c_custkey % 11 = 0 THEN 'D' ELSE 'O' END", " WHERE c_custkey % 13 <> 0"
    return (
        f"SELECT 't' || {_str('c_custkey')} AS table_name, 'trg' || {_str('c_custkey')} AS trigger_name, "
        f"'CREATE TRIGGER x ON ' || c_mktsegment AS definition, {enabled} AS enabled, 'public' AS function_schema, "
        f"'f' AS function_name, '' AS function_arguments FROM {{customer}}{where}"
    )


SNAPSHOT = {
    "schemas": schemas, "tables": tables, "columns": columns, "constraints": constraints, "indexes": indexes,
    "views": views, "matviews": matviews, "sequences": sequences, "functions": functions, "extensions": extensions,
    "triggers": triggers,
}

_NUM = "CAST({ck} AS INT) - CASE WHEN pk % 40 = 0 THEN 8 ELSE 0 END".format(ck="ck")

# Raw system tables of one server, ``env`` first.
RAW = {
    "namespace": f"SELECT 'a' AS env, s_suppkey AS oid, CASE WHEN s_suppkey = 0 THEN 'public' ELSE 'n' || {_str('s_suppkey')} END AS nspname FROM {{supplier}}",
    "class": f"""
SELECT 'a' AS env, o_orderkey AS oid, 't' || {_str('o_orderkey')} AS relname,
  CAST(CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS relnamespace,
  CASE o_orderkey % 6 WHEN 0 THEN 'r' WHEN 1 THEN 'p' WHEN 2 THEN 'v' WHEN 3 THEN 'm' WHEN 4 THEN 'i' ELSE 'S' END AS relkind,
  o_orderkey % 3 AS relam,
  CASE WHEN o_orderkey % 6 IN (2, 3) THEN 'SELECT ' || o_orderpriority END AS viewdef,
  CASE WHEN o_orderkey % 6 = 4 THEN 'CREATE INDEX t' || {_str('o_orderkey')} END AS indexdef,
  CASE WHEN o_orderkey % 8 = 0 THEN o_orderstatus END AS comment FROM {{orders}}""",
    "attribute": f"""
SELECT 'a' AS env, tk AS attrelid, 'c' || {_str('ck')} AS attname, {_NUM} AS attnum, pk % 50 AS atttypid,
  sk % 3 = 0 AS attnotnull, CASE pk % 23 WHEN 0 THEN 'a' WHEN 1 THEN 'd' ELSE '' END AS attidentity,
  CASE WHEN pk % 19 = 0 THEN 's' ELSE '' END AS attgenerated, pk % 4 AS attcollation, pk % 33 = 0 AS attisdropped,
  'ft' || rf AS formatted_type, CASE WHEN pk % 7 = 0 THEN ls END AS comment FROM {LINES}""",
    "type": f"SELECT DISTINCT 'a' AS env, CAST(p_size AS BIGINT) AS oid, 'ty' || {_str('p_size')} AS typname, CAST(p_size % 3 AS BIGINT) AS typcollation FROM {{part}}",
    "attrdef": f"SELECT 'a' AS env, tk AS adrelid, {_NUM} AS adnum, 'd' || rf AS expression FROM {LINES} WHERE pk % 5 = 0 OR pk % 19 = 0",
    "collation": f"SELECT 'a' AS env, CAST(n_nationkey AS BIGINT) AS oid, 'C' || {_str('n_nationkey')} AS collname FROM {{nation}}",
    "info_columns": f"""
SELECT 'a' AS env, 'public' AS table_schema, 't' || {_str('tk')} AS table_name, 'c' || {_str('ck')} AS column_name,
  'dt' || ls AS data_type, q AS character_maximum_length, q + 1 AS numeric_precision, CAST(2 AS INT) AS numeric_scale,
  CAST(NULL AS INT) AS datetime_precision FROM {LINES} WHERE pk % 7 <> 0""",
    "constraint": f"""
SELECT 'a' AS env, o_orderkey + 1000000 AS oid, 'con' || {_str('o_orderkey')} AS conname, o_orderkey AS conrelid,
  CASE WHEN o_orderkey % 3 = 0 THEN 'f' WHEN o_orderkey % 3 = 1 THEN 'p' ELSE 'c' END AS contype,
  'def ' || o_orderstatus AS definition, o_orderkey % 4 = 0 AS condeferrable, FALSE AS condeferred,
  'a' AS confupdtype, substr(o_orderpriority, 1, 1) AS confdeltype,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS confrelid,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN split('3,1', ',') WHEN 1 THEN split('2', ',') WHEN 2 THEN split('2,1,3', ',') END AS {{ints}}) AS conkey,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN split('2,1', ',') END AS {{ints}}) AS confkey FROM {{orders}}""",
    "index": """
SELECT 'a' AS env, o_orderkey AS indexrelid, o_custkey AS indrelid, o_orderkey % 4 = 0 AS indisunique, o_orderkey % 8 = 0 AS indisprimary,
  CASE WHEN o_orderkey % 5 = 0 THEN 'c1 > 0' END AS predicate, CASE WHEN o_orderkey % 10 = 0 THEN 'lower(c1)' END AS expressions,
  CAST(split(CASE WHEN o_orderkey % 10 = 0 THEN '3,0,1' ELSE '2,1' END, ',') AS {ints}) AS indkey,
  CAST(split(CASE WHEN o_orderkey % 10 = 0 THEN '5,3,5' ELSE '4,2' END, ',') AS {longs}) AS indclass
FROM {orders} WHERE o_orderkey % 6 = 4""",
    "opclass": f"SELECT 'a' AS env, s_suppkey AS oid, 'ops' || {_str('s_suppkey')} AS opcname FROM {{supplier}}",
    "am": f"SELECT 'a' AS env, CAST(n_nationkey AS BIGINT) AS oid, 'am' || {_str('n_nationkey')} AS amname FROM {{nation}}",
    "sequence": """
SELECT 'a' AS env, o_orderkey AS seqrelid, 'bigint' AS data_type, o_custkey AS seqstart, CAST(1 AS BIGINT) AS seqmin,
  o_custkey + 9 AS seqmax, CAST(1 AS BIGINT) AS seqincrement, CAST(1 AS BIGINT) AS seqcache, o_orderkey % 2 = 1 AS seqcycle
FROM {orders} WHERE o_orderkey % 6 = 5""",
    "depend": """
SELECT 'a' AS env, o_orderkey AS objid, o_custkey AS refobjid, CAST(1 + o_orderkey % 3 AS INT) AS refobjsubid,
  CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'i' WHEN 2 THEN 'n' ELSE 'e' END AS deptype FROM {orders}""",
    "proc": f"""
SELECT 'a' AS env, p_partkey AS oid, 'f' || {_str('p_size')} AS proname, CAST(CASE WHEN p_size = 9 THEN 2 ELSE 0 END AS BIGINT) AS pronamespace,
  CAST(p_size % 6 AS BIGINT) AS prolang, 'x ' || p_type AS identity_arguments, 'y ' || p_type AS arguments, p_brand AS return_type,
  'CREATE ' || p_name AS definition, 'v' AS volatility, p_size % 2 = 0 AS prosecdef, p_size % 3 = 0 AS proisstrict,
  CAST(NULL AS STRING) AS comment FROM {{part}}""",
    "language": "SELECT 'a' AS env, CAST(r_regionkey AS BIGINT) AS oid, lower(r_name) AS lanname FROM {region}",
    "extension": f"SELECT DISTINCT 'a' AS env, 'ext' || {_str('c_nationkey')} AS extname, '1.' || {_str('c_nationkey')} AS extversion, CAST(c_nationkey % 7 AS BIGINT) AS extnamespace FROM {{customer}}",
    "trigger": f"""
SELECT 'a' AS env, c_custkey AS oid, c_custkey AS tgrelid, 'trg' || {_str('c_custkey')} AS tgname, c_custkey % 300 AS tgfoid,
  'CREATE TRIGGER ' || c_name AS definition, 'O' AS tgenabled, c_custkey % 9 = 0 AS tgisinternal FROM {{customer}}""",
}

SPARK_TYPES = {"ints": "ARRAY<INT>", "longs": "ARRAY<BIGINT>", "strings": "ARRAY<STRING>"}
DUCKDB_TYPES = {"ints": "INT[]", "longs": "BIGINT[]", "strings": "VARCHAR[]"}


def frame(spark: SparkSession, folder: str, text: str, loaded: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a derivation over the sample tables in ``folder``; ``loaded`` keeps tables between calls."""
    loaded = {} if loaded is None else loaded
    for name, spelling in SPARK_TYPES.items():
        text = text.replace(f"{{{name}}}", spelling)
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    for n in names:
        if n not in loaded:
            loaded[n] = spark.read.parquet(f"{folder}/{n}.parquet")
    return spark.sql(text, **{n: loaded[n] for n in names})


def oracle(text: str) -> str:
    """The same derivation for DuckDB, where the sample tables are views."""
    for name, spelling in DUCKDB_TYPES.items():
        text = text.replace(f"{{{name}}}", spelling)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def catalogs(spark: SparkSession, folder: str, *kinds: str) -> tuple[Catalog, Catalog]:
    """Source and target snapshots with the given kinds of objects (all of them by default)."""
    kinds = kinds or tuple(CATALOG_DDL)
    loaded: dict[str, DataFrame] = {}
    return tuple(
        Catalog.from_snapshot(
            spark, {k: frame(spark, folder, SNAPSHOT[k](target), loaded) for k in kinds}, env="", schema="public"
        )
        for target in (False, True)
    )


def raw(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    loaded: dict[str, DataFrame] = {}
    return {n: frame(spark, folder, RAW[n], loaded) for n in names or RAW}


def ctes(*kinds: str) -> str:
    """``s_columns AS (...), t_columns AS (...)`` and so on, for the oracle SQL."""
    parts = []
    for kind in kinds:
        for prefix, target in (("s", False), ("t", True)):
            parts.append(f"{prefix}_{kind} AS ({oracle(SNAPSHOT[kind](target))})")
    return ",\n".join(parts)


def raw_ctes(*names: str) -> str:
    return ",\n".join(f'r_{n} AS ({oracle(RAW[n])})' for n in names)
