"""Catalog snapshots assembled from a server's raw system tables, or from lake tables and rules.

``RAW_QUERIES`` holds what the server has to render itself. Everything relational happens in Spark on
the raw tables, which may hold the system tables of many servers: they carry ``env`` as first column
and every join includes it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.model import CATALOG_DDL, Catalog, RuleSet
from tablecheck.operators.skew import keyed_join
from tablecheck.sources.checkpoints import shuffles_removed

# Raw relation -> statement that reads it from a PostgreSQL server.
RAW_QUERIES = {
    "namespace": "SELECT oid::bigint AS oid, nspname FROM pg_namespace",
    "class": (
        "SELECT oid::bigint AS oid, relname, relnamespace::bigint AS relnamespace, relkind::text AS relkind, "
        "relam::bigint AS relam, CASE WHEN relkind IN ('v', 'm') THEN pg_get_viewdef(oid, true) END AS viewdef, "
        "CASE WHEN relkind IN ('i', 'I') THEN pg_get_indexdef(oid) END AS indexdef, "
        "obj_description(oid, 'pg_class') AS comment FROM pg_class"
    ),
    "attribute": (
        "SELECT attrelid::bigint AS attrelid, attname, attnum::int AS attnum, atttypid::bigint AS atttypid, "
        "attnotnull, attidentity::text AS attidentity, attgenerated::text AS attgenerated, "
        "attcollation::bigint AS attcollation, attisdropped, format_type(atttypid, atttypmod) AS formatted_type, "
        "col_description(attrelid, attnum) AS comment FROM pg_attribute"
    ),
    "type": "SELECT oid::bigint AS oid, typname, typcollation::bigint AS typcollation FROM pg_type",
    "attrdef": (
        "SELECT adrelid::bigint AS adrelid, adnum::int AS adnum, pg_get_expr(adbin, adrelid) AS expression FROM pg_attrdef"
    ),
    "collation": "SELECT oid::bigint AS oid, collname FROM pg_collation",
    "info_columns": (
        "SELECT table_schema, table_name, column_name, data_type, character_maximum_length::int AS "
        "character_maximum_length, numeric_precision::int AS numeric_precision, numeric_scale::int AS numeric_scale, "
        "datetime_precision::int AS datetime_precision FROM information_schema.columns"
    ),
    "constraint": (
        "SELECT oid::bigint AS oid, conname, conrelid::bigint AS conrelid, contype::text AS contype, "
        "pg_get_constraintdef(oid, true) AS definition, condeferrable, condeferred, confupdtype::text AS confupdtype, "
        "confdeltype::text AS confdeltype, confrelid::bigint AS confrelid, conkey::int[] AS conkey, "
        "confkey::int[] AS confkey FROM pg_constraint"
    ),
    "index": (
        "SELECT indexrelid::bigint AS indexrelid, indrelid::bigint AS indrelid, indisunique, indisprimary, "
        "pg_get_expr(indpred, indrelid) AS predicate, pg_get_expr(indexprs, indrelid) AS expressions, "
        "indkey::int2[]::int[] AS indkey, indclass::oid[]::bigint[] AS indclass FROM pg_index"
    ),
    "opclass": "SELECT oid::bigint AS oid, opcname FROM pg_opclass",
    "am": "SELECT oid::bigint AS oid, amname FROM pg_am",
    "sequence": (
        "SELECT seqrelid::bigint AS seqrelid, format_type(seqtypid, NULL) AS data_type, seqstart, seqmin, seqmax, "
        "seqincrement, seqcache, seqcycle FROM pg_sequence"
    ),
    "depend": (
        "SELECT objid::bigint AS objid, refobjid::bigint AS refobjid, refobjsubid::int AS refobjsubid, "
        "deptype::text AS deptype FROM pg_depend"
    ),
    "proc": (
        "SELECT oid::bigint AS oid, proname, pronamespace::bigint AS pronamespace, prolang::bigint AS prolang, "
        "pg_get_function_identity_arguments(oid) AS identity_arguments, pg_get_function_arguments(oid) AS arguments, "
        "pg_get_function_result(oid) AS return_type, CASE WHEN prokind IN ('f', 'p') THEN pg_get_functiondef(oid) END "
        "AS definition, provolatile::text AS volatility, prosecdef, proisstrict, "
        "obj_description(oid, 'pg_proc') AS comment FROM pg_proc"
    ),
    "language": "SELECT oid::bigint AS oid, lanname FROM pg_language",
    "extension": "SELECT extname, extversion, extnamespace::bigint AS extnamespace FROM pg_extension",
    "trigger": (
        "SELECT oid::bigint AS oid, tgrelid::bigint AS tgrelid, tgname, tgfoid::bigint AS tgfoid, "
        "pg_get_triggerdef(oid, true) AS definition, tgenabled::text AS tgenabled, tgisinternal FROM pg_trigger"
    ),
}

Raw = Mapping[str, DataFrame]
c = F.col


def read_raw_jdbc(spark: SparkSession, options: Mapping[str, str], env: str) -> dict[str, DataFrame]:
    """The raw relations of one server."""
    return {
        name: spark.read.format("jdbc").options(**options).option("query", query).load().select(F.lit(env).alias("env"), "*")
        for name, query in RAW_QUERIES.items()
    }


def read_catalog_jdbc(spark: SparkSession, options: Mapping[str, str], env: str, schema: str = "public") -> Catalog:
    """A server's catalog; other engines than PostgreSQL are not covered by the raw queries."""
    return Catalog.from_snapshot(spark, build_catalog(read_raw_jdbc(spark, options, env), schema), env, schema)


def build_catalog(raw: Raw, schema: str) -> dict[str, DataFrame]:
    """All snapshot tables."""
    return {
        "schemas": build_schemas(raw, schema), "tables": build_tables(raw, schema),
        "columns": build_columns(raw, schema), "constraints": build_constraints(raw, schema),
        "indexes": build_indexes(raw, schema), "views": build_views(raw, schema, "v"),
        "matviews": build_views(raw, schema, "m"), "sequences": build_sequences(raw, schema),
        "functions": build_functions(raw, schema), "extensions": build_extensions(raw),
        "triggers": build_triggers(raw, schema),
    }


def _select(df: DataFrame, kind: str) -> DataFrame:
    names = [part.split()[0] for part in CATALOG_DDL[kind].split(", ")]
    return df.select("env", *names)


def _in_schema(raw: Raw, schema: str) -> DataFrame:
    return raw["namespace"].filter(c("nspname") == schema).select("env", c("oid").alias("ns_oid"), "nspname")


def _classes(raw: Raw, schema: str, *kinds: str) -> DataFrame:
    """Relations of the schema, optionally of given kinds."""
    classes = raw["class"].filter(c("relkind").isin(*kinds)) if kinds else raw["class"]
    classes = classes.withColumnRenamed("relnamespace", "ns_oid")
    return classes.join(_in_schema(raw, schema), ["env", "ns_oid"])


def build_schemas(raw: Raw, schema: str) -> DataFrame:
    return raw["namespace"].filter(c("nspname") == schema).select("env", c("nspname").alias("schema_name"))


def build_tables(raw: Raw, schema: str) -> DataFrame:
    return _classes(raw, schema, "r", "p").select(
        "env", c("relname").alias("table_name"), F.lit("BASE TABLE").alias("table_type")
    )


def build_columns(raw: Raw, schema: str) -> DataFrame:
    tables = _classes(raw, schema, "r", "p").select("env", c("oid").alias("attrelid"), "relname", "nspname")
    live = raw["attribute"].filter((c("attnum") > 0) & ~c("attisdropped"))
    types = raw["type"].select("env", c("oid").alias("atttypid"), "typname", "typcollation")
    defaults = raw["attrdef"].select("env", c("adrelid").alias("attrelid"), c("adnum").alias("attnum"), "expression")
    collations = raw["collation"].select("env", c("oid").alias("attcollation"), "collname")
    info = raw["info_columns"].select(
        "env", c("table_schema").alias("nspname"), c("table_name").alias("relname"),
        c("column_name").alias("attname"), "data_type", "character_maximum_length", "numeric_precision",
        "numeric_scale", "datetime_precision",
    )
    # Types and collations are few and columns many, so a single type may have a third of them.
    joined = (
        keyed_join(keyed_join(live.join(tables, ["env", "attrelid"]), types, ["env", "atttypid"], "inner"), collations,
                   ["env", "attcollation"])
        # A collation counts only where it is not the type's own.
        .withColumn("collname", F.when(c("attcollation") != c("typcollation"), c("collname")))
        .join(defaults, ["env", "attrelid", "attnum"], "left")
        .join(info, ["env", "nspname", "relname", "attname"], "left")
    )
    identity, generated = c("attidentity"), c("attgenerated")
    return _select(
        joined.select(
            "env", c("relname").alias("table_name"), c("attname").alias("column_name"),
            c("attnum").alias("ordinal_position"), c("expression").alias("column_default"),
            F.when(c("attnotnull"), "NO").otherwise("YES").alias("is_nullable"),
            F.coalesce("data_type", "formatted_type").alias("data_type"), c("typname").alias("udt_name"),
            "character_maximum_length", "numeric_precision", "numeric_scale", "datetime_precision",
            identity.alias("identity_kind"),
            F.when(identity == "a", "ALWAYS").when(identity == "d", "BY DEFAULT").otherwise("").alias("identity_generation"),
            generated.alias("generated_kind"),
            F.when(generated == "s", c("expression")).alias("generation_expression"),
            c("collname").alias("collation_name"), "comment", "formatted_type",
        ),
        "columns",
    )


def _key_names(keyed: DataFrame, ids: list[str], positions: str, names: DataFrame, on: list[str], out: str) -> DataFrame:
    """Names for an array of numbers, in the array's order; a group is one object's key."""
    numbered = keyed.select(*dict.fromkeys(ids + [x for x in on if x != "number"]), F.posexplode(positions).alias("pos", "number"))
    packed = F.sort_array(F.collect_list(F.struct("pos", "name")))
    # Many objects may refer to one name, such as the key of a table that most others refer to.
    named = keyed_join(numbered, names, on, "inner")
    return named.groupBy(*ids).agg(F.transform(packed, lambda x: x["name"]).alias(out))


def _attribute_names(raw: Raw, relation: str) -> DataFrame:
    return raw["attribute"].select("env", c("attrelid").alias(relation), c("attnum").alias("number"), c("attname").alias("name"))


_NONE = "array<string>"


def build_constraints(raw: Raw, schema: str) -> DataFrame:
    owners = _classes(raw, schema).select("env", c("oid").alias("conrelid"), c("relname").alias("table_name"))
    parents = raw["class"].select(
        "env", c("oid").alias("confrelid"), c("relname").alias("referenced_table"), c("relnamespace").alias("ref_ns")
    ).join(
        raw["namespace"].select("env", c("oid").alias("ref_ns"), c("nspname").alias("referenced_schema")),
        ["env", "ref_ns"], "left",
    )
    found = raw["constraint"].join(owners, ["env", "conrelid"])
    columns = _key_names(found, ["env", "oid"], "conkey", _attribute_names(raw, "conrelid"), ["env", "conrelid", "number"], "columns")
    referenced = _key_names(
        found, ["env", "oid"], "confkey", _attribute_names(raw, "confrelid"), ["env", "confrelid", "number"],
        "referenced_columns",
    )
    joined = (
        # Constraints other than foreign keys all name table 0; the join spreads them.
        keyed_join(found, parents, ["env", "confrelid"])
        .join(columns, ["env", "oid"], "left")
        .join(referenced, ["env", "oid"], "left")
    )
    none = F.array().cast(_NONE)
    return _select(
        joined.select(
            "env", c("conname").alias("constraint_name"), "table_name", c("contype").alias("constraint_type"), "definition",
            c("condeferrable").alias("deferrable"), c("condeferred").alias("initially_deferred"),
            c("confupdtype").alias("on_update"), c("confdeltype").alias("on_delete"), "referenced_schema",
            F.coalesce("columns", none).alias("columns"), "referenced_table",
            F.coalesce("referenced_columns", none).alias("referenced_columns"),
        ),
        "constraints",
    )


def build_indexes(raw: Raw, schema: str) -> DataFrame:
    owners = _classes(raw, schema).select(
        "env", c("oid").alias("indrelid"), c("relname").alias("table_name"), c("nspname").alias("schema_name")
    )
    own = raw["class"].select("env", c("oid").alias("indexrelid"), c("relname").alias("index_name"), "relam", "indexdef", "comment")
    methods = raw["am"].select("env", c("oid").alias("relam"), c("amname").alias("method"))
    found = raw["index"].join(owners, ["env", "indrelid"])
    ids = ["env", "indexrelid"]
    # Position 0 stands for an expression and has no column.
    plain = _attribute_names(raw, "indrelid").filter("number > 0")
    columns = _key_names(found, ids, "indkey", plain, ["env", "indrelid", "number"], "columns")
    classes = raw["opclass"].select("env", c("oid").alias("number"), c("opcname").alias("name"))
    opclasses = _key_names(found, ids, "indclass", classes, ["env", "number"], "opclasses")
    joined = found.join(own, ids).join(methods, ["env", "relam"]).join(columns, ids, "left").join(opclasses, ids, "left")
    none = F.array().cast(_NONE)
    return _select(
        joined.withColumnsRenamed({"indisunique": "is_unique", "indisprimary": "is_primary"})
        .withColumn("columns", F.coalesce("columns", none))
        .withColumn("opclasses", F.coalesce("opclasses", none)),
        "indexes",
    )


def build_views(raw: Raw, schema: str, kind: str = "v") -> DataFrame:
    """Views (``v``) or materialized views (``m``)."""
    found = _classes(raw, schema, kind)
    return found.select("env", c("relname").alias("view_name"), c("viewdef").alias("view_definition"), "comment")


def build_sequences(raw: Raw, schema: str) -> DataFrame:
    own = _classes(raw, schema).select("env", c("oid").alias("seqrelid"), c("relname").alias("sequence_name"))
    owned = raw["depend"].filter(c("deptype").isin("a", "i")).select(
        "env", c("objid").alias("seqrelid"), "refobjid", c("refobjsubid").alias("attnum")
    )
    owners = raw["class"].select("env", c("oid").alias("refobjid"), c("relname").alias("owner_table"))
    columns = raw["attribute"].select("env", c("attrelid").alias("refobjid"), "attnum", c("attname").alias("owner_column"))
    joined = (
        raw["sequence"].join(own, ["env", "seqrelid"])
        .join(owned, ["env", "seqrelid"], "left")
        .join(owners, ["env", "refobjid"], "left")
        .join(columns, ["env", "refobjid", "attnum"], "left")
    )
    renamed = {
        "seqstart": "start_value", "seqmin": "minimum_value", "seqmax": "maximum_value", "seqincrement": "increment",
        "seqcache": "cache_size", "seqcycle": "cycle",
    }
    return _select(joined.withColumnsRenamed(renamed), "sequences")


def build_functions(raw: Raw, schema: str) -> DataFrame:
    languages = raw["language"].select("env", c("oid").alias("prolang"), c("lanname").alias("language"))
    procs = raw["proc"].withColumnRenamed("pronamespace", "ns_oid")
    joined = procs.join(_in_schema(raw, schema), ["env", "ns_oid"]).join(languages, ["env", "prolang"])
    renamed = {
        "nspname": "schema_name", "proname": "function_name", "prosecdef": "security_definer",
        "proisstrict": "strict_null_input",
    }
    return _select(joined.withColumnsRenamed(renamed), "functions")


def build_extensions(raw: Raw) -> DataFrame:
    spaces = raw["namespace"].select("env", c("oid").alias("extnamespace"), c("nspname").alias("schema_name"))
    joined = raw["extension"].join(spaces, ["env", "extnamespace"])
    return _select(joined.withColumnsRenamed({"extname": "extension_name", "extversion": "version"}), "extensions")


def build_triggers(raw: Raw, schema: str) -> DataFrame:
    owners = _classes(raw, schema).select("env", c("oid").alias("tgrelid"), c("relname").alias("table_name"))
    spaces = raw["namespace"].select("env", c("oid").alias("pronamespace"), c("nspname").alias("function_schema"))
    procs = raw["proc"].select(
        "env", c("oid").alias("tgfoid"), c("proname").alias("function_name"), "pronamespace",
        c("identity_arguments").alias("function_arguments"),
    ).join(spaces, ["env", "pronamespace"])
    own = raw["trigger"].filter(~c("tgisinternal")).join(owners, ["env", "tgrelid"])
    joined = keyed_join(own.drop("oid"), procs, ["env", "tgfoid"], "inner")
    return _select(joined.withColumnsRenamed({"tgname": "trigger_name", "tgenabled": "enabled"}), "triggers")


# Spark type -> type name as a catalog spells it.
_TYPE_NAMES = {
    "string": "text", "int": "integer", "bigint": "bigint", "smallint": "smallint", "tinyint": "smallint",
    "boolean": "boolean", "date": "date", "double": "double precision", "float": "real", "binary": "bytea",
    "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone",
}


def _catalog_type(kind: str) -> str:
    if kind.startswith("decimal"):
        return "numeric"
    return "ARRAY" if kind.startswith("array") else _TYPE_NAMES.get(kind, kind)


def catalog_from_dataframes(
    spark: SparkSession, tables: Mapping[str, DataFrame], rules: RuleSet, schema: str = "public"
) -> Catalog:
    """A catalog for lake tables: columns from their schemas, nullability and keys from the rules.

    Parquet reads report every column as nullable, so nullability comes from the rules alone.
    """
    required = {(r.table, r.column) for r in rules.required}
    columns = []
    for table, df in sorted(tables.items()):
        for i, f in enumerate(df.schema.fields, 1):
            kind = f.dataType.simpleString()
            precision = (f.dataType.precision, f.dataType.scale) if kind.startswith("decimal") else (None, None)
            columns.append((
                table, f.name, i, None, "NO" if (table, f.name) in required else "YES", _catalog_type(kind), kind, None,
                *precision, None, "", "", "", None, None, None, kind,
            ))
    constraints = [
        (k.name, k.table, k.kind, f"{'PRIMARY KEY' if k.kind == 'p' else 'UNIQUE'} ({', '.join(k.columns)})", False,
         False, None, None, None, list(k.columns), None, [])
        for k in rules.keys
    ] + [
        (f.name, f.table, "f",
         f"FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.parent}({', '.join(f.parent_columns)})", False, False,
         "a", "a", f.parent_schema or schema, list(f.columns), f.parent, list(f.parent_columns))
        for f in rules.foreign_keys
    ]
    parts = {
        "schemas": spark.createDataFrame([(schema,)], CATALOG_DDL["schemas"]),
        "tables": spark.createDataFrame([(t, "BASE TABLE") for t in sorted(tables)], CATALOG_DDL["tables"]),
        "columns": spark.createDataFrame(columns, CATALOG_DDL["columns"]),
        "constraints": spark.createDataFrame(constraints, CATALOG_DDL["constraints"]),
    }
    return Catalog.from_snapshot(spark, parts, env="", schema=schema)


def write_snapshot(parts: Mapping[str, DataFrame], root: str) -> None:
    """Store snapshot tables so that a comparison reads only the environments it compares. Environments that are in
    ``parts`` replace what is stored of them; the others stay."""
    for kind, df in parts.items():
        with shuffles_removed(df.sparkSession):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("env").parquet(f"{root}/{kind}", compression="zstd")


def read_snapshot(spark: SparkSession, root: str, env: str, schema: str = "public") -> Catalog:
    parts = {kind: spark.read.schema(f"{ddl}, env STRING").parquet(f"{root}/{kind}") for kind, ddl in CATALOG_DDL.items()}
    return Catalog.from_snapshot(spark, parts, env, schema)
