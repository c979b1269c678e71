import pytest
from pyspark.sql import functions as F

from tablecheck.functions import ddl, text
from tablecheck.model import CATALOG_DDL


# Texts and what is left of them: letter case, runs of white space, and semicolons at the end do not count.
CASES = [
    (None, ""), ("", ""), ("  ", ""), ("SELECT 1", "select 1"), ("a;b;;", "a;b"), (" a \t b\n;", "a b"), ("x ; ;", "x ;"), (";;", ""),
    (" Select X ;", "select x"), ("\x1ca\x1fb", "a b"), ("it's  \\n", "it's \\n"),
]


def test_normalize_sql(spark):
    df = spark.createDataFrame([(v,) for v, _ in CASES], "x STRING")
    got = [r[0] for r in df.select(text.normalize_sql("x")).collect()]
    assert got == [expected for _, expected in CASES]


@pytest.mark.parametrize(
    "engine, name, quoted", [("postgresql", 'dep"th', '"dep""th"'), ("mysql", "le`ft", "`le``ft`"), ("sqlserver", "en]d", "[en]]d]")]
)
def test_quoting(spark, engine, name, quoted):
    assert spark.range(1).select(text.quote_ident(F.lit(name), engine)).first()[0] == quoted
    assert text.quote_name(name, engine) == quoted


def test_qualify_and_literal(spark):
    row = spark.range(1).select(text.qualify(F.lit("ware house"), F.lit('pal"let')), text.sql_literal(F.lit("o'clock"))).first()
    assert list(row) == ['"ware house"."pal""let"', "'o''clock'"]
    assert text.qualify_name("ware house", 'pal"let') == '"ware house"."pal""let"'


def test_sql_string_survives_quotes_and_backslashes(spark):
    for value in ("pl'ain", "back\\slash", 'dou"ble'):
        assert spark.range(1).select(F.expr(text.sql_string(value))).first()[0] == value


def test_constraint_text(spark):
    value = "CHECK (a = ANY (ARRAY['x'::character varying::text])::text[])"
    got = spark.range(1).select(text.constraint_text(F.lit(value))).first()[0]
    assert got == "check(a=any(array['x'::charactervarying]))"


@pytest.mark.parametrize(
    "values, expected",
    [
        ({"data_type": "character varying", "character_maximum_length": 9}, "VARCHAR(9)"),
        ({"data_type": "character varying"}, "VARCHAR"),
        ({"data_type": "character", "character_maximum_length": 2}, "CHAR(2)"),
        ({"data_type": "numeric", "numeric_precision": 8, "numeric_scale": 2}, "NUMERIC(8,2)"),
        ({"data_type": "numeric"}, "NUMERIC"),
        ({"data_type": "timestamp without time zone"}, "TIMESTAMP"),
        ({"data_type": "timestamp with time zone"}, "TIMESTAMPTZ"),
        ({"data_type": "USER-DEFINED", "udt_name": 'mo"od'}, '"mo""od"'),
        ({"data_type": "ARRAY", "udt_name": "_int4_x"}, "int4_x[]"),
        ({"data_type": "double precision"}, "DOUBLE PRECISION"),
        ({"data_type": "integer", "formatted_type": "int4"}, "int4"),
    ],
)
def test_type_text(spark, values, expected):
    names = [p.split()[0] for p in CATALOG_DDL["columns"].split(", ")]
    df = spark.createDataFrame([tuple(values.get(n) for n in names)], CATALOG_DDL["columns"])
    assert df.select(ddl.type_text()).first()[0] == expected


def test_comment_lines(spark):
    row = spark.range(1).select(ddl.comment_lines(F.lit("a\nb\r\nc")), ddl.comment_lines(F.lit(""))).first()
    assert list(row) == ["-- a\n-- b\n-- c", "-- (absent or not available)"]
