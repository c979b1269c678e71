from catalogs import catalog

from tablecheck.operators import drift
from tablecheck.operators.structure import structure_diff, table_ddl


def codes(df):
    return sorted((r.type, r.impact, r.object_name) for r in df.collect())


def test_every_kind_is_reported_once_when_missing(spark):
    source = catalog(
        spark,
        schemas=[{"schema_name": "public"}],
        tables=[{"table_name": "a"}, {"table_name": "b"}],
        columns=[
            {"table_name": "a", "column_name": "id", "is_nullable": "NO"},
            {"table_name": "a", "column_name": "x", "is_nullable": "NO", "ordinal_position": 2},
            {"table_name": "b", "column_name": "id"},
        ],
        constraints=[
            {"constraint_name": "a_pk", "table_name": "a", "constraint_type": "p", "definition": "PRIMARY KEY (id)", "columns": ["id"]},
            {"constraint_name": "a_nn", "table_name": "a", "constraint_type": "n", "definition": "NOT NULL id", "columns": ["id"]},
        ],
        indexes=[
            {"table_name": "a", "index_name": "a_pk", "indexdef": "CREATE UNIQUE INDEX a_pk", "is_unique": True, "columns": ["id"]},
            {"table_name": "a", "index_name": "a_x", "indexdef": "CREATE INDEX a_x", "columns": ["x"], "opclasses": ["gin_trgm_ops"]},
        ],
        views=[{"view_name": "v", "view_definition": " SELECT 1; "}],
        matviews=[{"view_name": "m", "view_definition": "SELECT 2"}],
        sequences=[{"sequence_name": "s", "owner_table": "a", "owner_column": "id"}],
        functions=[{"function_name": "f", "definition": "SELECT soundex('x')\n"}],
        extensions=[{"extension_name": "hstore"}],
        triggers=[{"table_name": "a", "trigger_name": "t", "definition": "CREATE TRIGGER t"}],
    )
    target = catalog(
        spark, tables=[{"table_name": "a"}], columns=[{"table_name": "a", "column_name": "id", "is_nullable": "YES"}]
    )
    found = drift.drift(source, target)
    assert codes(found) == [
        ("COLUMN_DIFFERENT", "HIGH", "id"),
        ("COLUMN_MISSING", "CRITICAL", "x"),
        ("CONSTRAINT_MISSING_OR_DIFFERENT", "CRITICAL", "a_pk"),
        ("EXTENSION_MISSING", "HIGH", "fuzzystrmatch"),
        ("EXTENSION_MISSING", "HIGH", "hstore"),
        ("EXTENSION_MISSING", "HIGH", "pg_trgm"),
        ("FUNCTION_MISSING_OR_DIFFERENT", "HIGH", "public.f()"),
        ("INDEX_MISSING_OR_DIFFERENT", "MEDIUM", "a_x"),
        ("MATERIALIZED_VIEW_MISSING_OR_DIFFERENT", "HIGH", "m"),
        ("SCHEMA_MISSING", "HIGH", "public"),
        ("SEQUENCE_MISSING_OR_DIFFERENT", "HIGH", "s"),
        ("TABLE_MISSING", "CRITICAL", "b"),
        ("TRIGGER_MISSING_OR_DIFFERENT", "HIGH", "t"),
        ("VIEW_MISSING_OR_DIFFERENT", "MEDIUM", "v"),
    ]
    statements = {r.type: r.sql for r in found.collect()}
    assert statements["TABLE_MISSING"] == 'CREATE TABLE "public"."b" (\n    "id" INTEGER\n);'
    assert statements["VIEW_MISSING_OR_DIFFERENT"] == 'CREATE OR REPLACE VIEW "public"."v" AS\nSELECT 1;;'
    assert 'OWNED BY "public"."a"."id";' in statements["SEQUENCE_MISSING_OR_DIFFERENT"]
    assert drift.drift(source, source).filter("type <> 'EXTENSION_MISSING'").isEmpty()


def test_generated_column_is_recreated_with_its_indexes(spark):
    area = {"table_name": "plot", "column_name": "area", "data_type": "integer", "formatted_type": "integer"}
    source = catalog(
        spark, tables=[{"table_name": "plot"}], columns=[{**area, "generated_kind": "s", "generation_expression": "width * depth"}],
    )
    by_area = "CREATE INDEX by_area ON public.plot (area DESC)"
    target = catalog(
        spark, tables=[{"table_name": "plot"}], columns=[area],
        indexes=[
            {"table_name": "plot", "index_name": "by_area", "columns": ["area"], "indexdef": by_area},
            {"table_name": "plot", "index_name": "by_owner", "columns": ["owner"], "indexdef": "CREATE INDEX by_owner ON public.plot (owner)"},
        ],
    )
    (row,) = drift.column_drift(source, target).collect()
    assert (row.type, row.impact) == ("COLUMN_DIFFERENT", "CRITICAL")
    statements = [x for x in row.sql.split("\n") if not x.startswith("--")]
    assert statements == [
        'DROP INDEX IF EXISTS "public"."by_area";',
        'ALTER TABLE "public"."plot" DROP COLUMN IF EXISTS "area";',
        'ALTER TABLE "public"."plot" ADD COLUMN "area" integer GENERATED ALWAYS AS (width * depth) STORED;',
        f"{by_area};",
    ]


def key(table, name="pk", kind="p", columns=("id",)):
    return {"table_name": table, "constraint_name": f"{table}_{name}", "constraint_type": kind, "columns": list(columns),
            "definition": f"PRIMARY KEY ({', '.join(columns)})"}


def test_scope_of_constraints(spark):
    source = catalog(spark, constraints=[key("a"), key("b")])
    target = catalog(spark, constraints=[key("a")])
    assert codes(drift.constraint_drift(source, target)) == [("CONSTRAINT_MISSING_OR_DIFFERENT", "CRITICAL", "b_pk")]
    assert drift.constraint_drift(source, target, scope="schema").isEmpty()


def test_unique_index_stands_in_for_a_key(spark):
    source = catalog(spark, constraints=[key("a"), key("b"), key("c")])
    index = {"is_unique": True, "columns": ["id"], "indexdef": "x"}
    target = catalog(
        spark,
        indexes=[
            {**index, "table_name": "a", "index_name": "i"},
            {**index, "table_name": "b", "index_name": "j", "predicate": "id > 0"},
            {**index, "table_name": "c", "index_name": "k", "is_unique": False},
        ],
    )
    assert [n for _, _, n in codes(drift.constraint_drift(source, target))] == ["b_pk", "c_pk"]


def test_index_under_another_name(spark):
    source = catalog(spark, indexes=[{"table_name": "a", "index_name": "i", "indexdef": "CREATE INDEX i ON a(x)", "columns": ["x"]}])
    target = catalog(spark, indexes=[{"table_name": "a", "index_name": "j", "indexdef": "CREATE INDEX j ON a(x)", "columns": ["x"]}])
    assert drift.index_drift(source, target).count() == 1
    assert drift.index_drift(source, target, ignore_name=True).isEmpty()


def test_index_definition_moves_to_the_target_schema(spark):
    source = catalog(
        spark, schema="src",
        indexes=[{"schema_name": "src", "table_name": "a", "index_name": "i", "indexdef": 'CREATE INDEX i ON "src"."a" (x);', "expressions": "x"}],
    )
    (row,) = drift.index_drift(source, catalog(spark, schema="dst")).collect()
    assert (row.impact, row.sql) == ("HIGH", 'CREATE INDEX i ON "dst"."a" (x);')


def test_structure_in_both_directions(spark):
    def side(columns, constraints):
        return catalog(spark, tables=[{"table_name": "t"}], columns=[{"table_name": "t", **c} for c in columns], constraints=constraints)

    def check(name, text):
        return {"table_name": "t", "constraint_name": name, "constraint_type": "c", "definition": text}

    source = side(
        [{"column_name": "a", "is_nullable": "NO", "column_default": "1"}, {"column_name": "b"}, {"column_name": "c"}],
        [check("k1", "CHECK (a > 1)"), check("k2", "CHECK (b)"), check("k3", "CHECK (c)")],
    )
    target = side(
        [{"column_name": "b", "data_type": "text"}, {"column_name": "c"}, {"column_name": "z"}],
        [check("other", "check(a >1)"), check("k2", "CHECK (b OR c)"), check("k4", "CHECK (z)")],
    )
    found = sorted((r.type, r.impact, r.object_name) for r in structure_diff(source, target).collect())
    assert found == [
        ("COLUMN_DIFFERENT", "HIGH", "b"),
        ("COLUMN_MISSING", "CRITICAL", "a"),
        ("CONSTRAINT_DIFFERENT", "HIGH", "k2"),
        ("CONSTRAINT_DIFFERENT", "HIGH", "k3"),
        ("CONSTRAINT_DIFFERENT", "MEDIUM", "k4"),
        ("EXTRA_COLUMN", "MEDIUM", "z"),
    ]
    back = sorted((r.type, r.impact, r.object_name) for r in structure_diff(target, source).collect())
    assert ("EXTRA_COLUMN", "MEDIUM", "a") in back and ("COLUMN_MISSING", "MEDIUM", "z") in back


def test_table_ddl(spark):
    c = catalog(
        spark, tables=[{"table_name": "t"}, {"table_name": "empty"}],
        columns=[
            {"table_name": "t", "column_name": "b", "ordinal_position": 2, "column_default": "now()"},
            {"table_name": "t", "column_name": "a", "is_nullable": "NO", "identity_generation": "ALWAYS"},
        ],
        constraints=[key("t"), {"table_name": "t", "constraint_name": "nn", "constraint_type": "n", "definition": "NOT NULL a"}],
        indexes=[
            {"table_name": "t", "index_name": "t_pk", "indexdef": "CREATE UNIQUE INDEX t_pk"},
            {"table_name": "t", "index_name": "z", "indexdef": "CREATE INDEX z;"},
        ],
    )
    texts = {r.table_name: r.ddl for r in table_ddl(c).collect()}
    assert texts["t"] == (
        'CREATE TABLE "public"."t" (\n    "a" INTEGER GENERATED ALWAYS AS IDENTITY NOT NULL,\n    "b" INTEGER DEFAULT now()\n);\n\n'
        'ALTER TABLE "public"."t" ADD CONSTRAINT "t_pk" PRIMARY KEY (id);\n\nCREATE INDEX z;'
    )
    assert texts["empty"] == 'CREATE TABLE "public"."empty" (\n\n);'


def test_indexes_move_with_quoted_and_plain_schemas(spark):
    from pyspark.sql import functions as F

    cases = [
        ('CREATE INDEX i ON "sales".t USING btree (a);', "sales", 'CREATE INDEX i ON "web".t USING btree (a);'),
        ("CREATE UNIQUE INDEX i ON ONLY sales.t (a) WHERE a <> 'x ON sales.t';;", "sales", """CREATE UNIQUE INDEX i ON ONLY "web".t (a) WHERE a <> 'x ON sales.t';"""),
        ('CREATE INDEX "a ON b" ON sales.t (lower("sales".f(a)))', "sales", 'CREATE INDEX "a ON b" ON "web".t (lower("sales".f(a)));'),
        ("CREATE INDEX i ON t (a)", "sales", "CREATE INDEX i ON t (a);"),
        ("CREATE INDEX i ON presales.t (a)", "sales", "CREATE INDEX i ON presales.t (a);"),
        ('CREATE INDEX i ON "Sa""les".t (a)', 'Sa"les', 'CREATE INDEX i ON "web".t (a);'),
        ("CREATE INDEX i ON sales.t (a)", "Sales", "CREATE INDEX i ON sales.t (a);"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "d STRING, s STRING")
    got = [r[0] for r in df.select(drift.move_index(F.col("d"), F.col("s"), F.lit("web"))).collect()]
    assert got == [c[2] for c in cases]
