"""Small catalogs made of keyword rows."""

from tablecheck.model import CATALOG_DDL, Catalog

DEFAULTS = {
    "columns": {
        "ordinal_position": 1, "is_nullable": "YES", "data_type": "integer", "udt_name": "int4", "identity_kind": "",
        "identity_generation": "", "generated_kind": "",
    },
    "constraints": {"deferrable": False, "initially_deferred": False, "columns": [], "referenced_columns": []},
    "indexes": {"schema_name": "public", "method": "btree", "is_unique": False, "is_primary": False, "columns": [], "opclasses": []},
    "sequences": {
        "data_type": "bigint", "start_value": 1, "minimum_value": 1, "maximum_value": 9, "increment": 1, "cache_size": 1,
        "cycle": False,
    },
    "functions": {
        "schema_name": "public", "identity_arguments": "", "language": "sql", "volatility": "v", "security_definer": False,
        "strict_null_input": False,
    },
    "triggers": {"enabled": "O", "function_schema": "public", "function_name": "f", "function_arguments": ""},
    "tables": {"table_type": "BASE TABLE"},
}


def catalog(spark, schema="public", **kinds):
    parts = {}
    for kind, found in kinds.items():
        names = [p.split()[0] for p in CATALOG_DDL[kind].split(", ")]
        values = [tuple({**DEFAULTS.get(kind, {}), **row}.get(n) for n in names) for row in found]
        parts[kind] = spark.createDataFrame(values, CATALOG_DDL[kind])
    return Catalog.from_snapshot(spark, parts, env="", schema=schema)
