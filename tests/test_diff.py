import datetime as dt

import pytest
from catalogs import catalog
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecheck.model import Side
from tablecheck.operators import diff

NAN = float("nan")


def counts(source, target, **kw):
    r = diff.compare_data(source, target, **kw).first()
    return r.source_row_count, r.target_row_count, r.only_source_count, r.only_target_count, r.data_equal


def test_rows_of_one_side_only(spark, rows):
    source = spark.createDataFrame([("oak", 4), ("elm", 1), ("fir", 9)], "tree STRING, n INT")
    target = spark.createDataFrame([("elm", 1), ("fir", 8), ("ash", None), ("oak", 4)], "tree STRING, n INT")
    assert counts(source, target) == (3, 4, 1, 2, False)
    excess = diff.excess_rows(diff.bag_counts(source, target))
    assert rows(diff.diff_samples(excess, "source")) == [("fir", 9)]
    assert rows(diff.diff_samples(excess, "target")) == [("ash", None), ("fir", 8)]


def test_buckets_see_values_that_move_between_columns_and_places(spark):
    def frames(left, right, ddl):
        return spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl)

    pairs = [
        frames([(1, None, 5)], [(1, 5, None)], "a INT, b INT, c INT"),
        frames([([1, None],)], [([None, 1],)], "a ARRAY<INT>"),
        frames([([1], [2])], [([1, 2], [])], "a ARRAY<INT>, b ARRAY<INT>"),
        frames([((1, None),)], [((None, 1),)], "s STRUCT<x: INT, y: INT>"),
        frames([({"a": None, "b": 1},)], [({"a": 1, "b": None},)], "m MAP<STRING, INT>"),
        frames([(None, [])], [([], None)], "a ARRAY<INT>, b ARRAY<INT>"),
    ]
    for a, b in pairs:
        for bucket_rows in (0, 1, 64):
            assert counts(a, b, bucket_rows=bucket_rows) == (1, 1, 1, 1, False), (a.collect(), bucket_rows)
            assert counts(a, a, bucket_rows=bucket_rows) == (1, 1, 0, 0, True)


def test_decimals_are_compared_without_rounding(spark):
    def one(value, kind):
        return spark.range(1).select(F.lit(value).cast(kind).alias("v"))

    def same(a, b):
        return counts(one(*a), one(*b))[4] and counts(one(*b), one(*a))[4]

    wide, whole = "DECIMAL(38,18)", "DECIMAL(38,0)"
    assert not same(("1.4", wide), ("1", whole)) and same(("1.000", wide), ("1", whole)) and same(("-7", wide), ("-7", whole))
    assert same(("0.000000000000000001", wide), ("0.000000000000000001", "DECIMAL(20,20)"))
    assert not same(("0.000000000000000001", wide), ("0", whole)) and same(("0", wide), ("0", whole))
    assert same(("9223372036854775807", "BIGINT"), ("9223372036854775807", "DECIMAL(38,19)"))
    assert not same(("9223372036854775807", "BIGINT"), ("9223372036854775806.5", "DECIMAL(38,19)"))
    assert not same(("9007199254740993", "DECIMAL(20,0)"), ("9007199254740992", "DOUBLE"))
    assert same(("9007199254740992", "DECIMAL(20,0)"), ("9007199254740992", "DOUBLE"))
    assert same(("-0.375", wide), ("-0.375", "DOUBLE")) and not same(("0.1", wide), ("0.1", "DOUBLE"))
    assert same(("0.0000000000000001220703125", "DECIMAL(38,30)"), ("0.0000000000000001220703125", "DOUBLE")) is False
    assert same(("0.000030517578125", wide), ("0.000030517578125", "FLOAT")) and same(("0", whole), ("-0.0", "DOUBLE"))
    assert same(("99999999999999991611392", whole), ("1e23", "DOUBLE")) and not same(("100000000000000000000000", whole), ("1e23", "DOUBLE"))
    assert not same(("1", whole), ("NaN", "DOUBLE")) and same(("1.50", "DECIMAL(5,2)"), ("1.5", "DECIMAL(12,1)"))


def test_copies_nulls_nan_zero_and_arrays(spark, rows):
    ddl = "i INT, d DOUBLE, s STRING, a ARRAY<INT>"
    source = spark.createDataFrame(
        [(1, 0.0, "x", [1]), (1, 0.0, "x", [1]), (1, 0.0, "x", [1]), (None, NAN, None, None), (2, 1.0, "y", [])], ddl
    )
    target = spark.createDataFrame([(1, -0.0, "x", [1]), (None, NAN, None, None), (2, 1.0, "y", [None])], ddl)
    assert counts(source, target) == (5, 3, 3, 1, False)
    excess = diff.excess_rows(diff.bag_counts(source, target))
    assert rows(diff.diff_samples(excess, "source", 2)) == [(1, 0.0, "x", [1]), (1, 0.0, "x", [1])]
    assert diff.diff_samples(excess, "source", 20).count() == 3
    assert counts(source, source) == (5, 5, 0, 0, True)


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "a INT")
    assert counts(empty, empty) == (0, 0, 0, 0, True)
    assert counts(empty, spark.createDataFrame([(None,)], "a INT")) == (0, 1, 0, 1, False)
    assert counts(empty, empty, bucket_rows=8) == (0, 0, 0, 0, True)


def test_maps_can_be_compared(spark):
    a = spark.sql("SELECT map('k', 1) AS m UNION ALL SELECT map('k', 1)")
    b = spark.sql("SELECT map('k', 1) AS m")
    assert counts(a, b) == (2, 1, 1, 0, False)
    assert diff.diff_samples(diff.excess_rows(diff.bag_counts(a, b))).count() == 1


def test_unlike_types_never_match_but_nulls_do(spark):
    text = spark.createDataFrame([("01",), ("1",), (None,)], "x STRING")
    number = spark.createDataFrame([(1,), (1,), (None,)], "x INT")
    assert counts(text, number) == (3, 3, 2, 2, False)
    moment = dt.datetime(2020, 1, 1)
    assert counts(
        spark.createDataFrame([(moment,), (None,)], "t TIMESTAMP"), spark.createDataFrame([(moment,), (None,)], "t TIMESTAMP_NTZ")
    ) == (2, 2, 1, 1, False)


def test_numbers_match_by_value(spark):
    big = 2**53 + 1
    whole = spark.createDataFrame([(1,), (big,), (None,)], "x BIGINT")
    real = spark.createDataFrame([(1.0,), (float(2**53),), (None,)], "x DOUBLE")
    assert counts(whole, real) == (3, 3, 1, 1, False)
    assert counts(spark.createDataFrame([(True,)], "x BOOLEAN"), spark.createDataFrame([(1,)], "x INT")) == (1, 1, 0, 0, True)
    assert counts(spark.sql("SELECT CAST(1.50 AS DECIMAL(5,2)) x"), spark.sql("SELECT CAST(1.5 AS DECIMAL(9,4)) x"))[4]


def test_column_gate(spark):
    source = spark.createDataFrame([(1, "a")], "id INT, name STRING")
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, Name STRING")
    row = diff.compare_data(source, target).first()
    assert (row.data_compared, row.data_equal, row.source_row_count, row.target_row_count) == (False, False, 1, 2)
    assert row.only_source_count == 0 and row.data_skip_reason
    swapped = spark.createDataFrame([("a", 1)], "name STRING, id INT")
    assert counts(source, swapped) == (1, 1, 0, 0, True)


def test_names_that_differ_in_case_only(spark):
    both = spark.createDataFrame([(1, 2)], "a INT, A INT")
    with pytest.raises(ValueError):
        diff.bag_counts(both, both)


NUMBER = st.integers(0, 2) | st.none()
VALUES = st.lists(st.tuples(NUMBER, NUMBER, st.lists(NUMBER, max_size=2) | st.none()), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES, VALUES)
def test_same_as_except_all_both_ways(spark, left, right):
    a, b = (spark.createDataFrame(v, "i INT, j INT, a ARRAY<INT>") for v in (left, right))
    expected = (len(left), len(right), a.exceptAll(b).count(), b.exceptAll(a).count())
    assert counts(a, b)[:4] == expected
    assert counts(a, b, bucket_rows=2)[:4] == expected


def test_buckets_leave_out_equal_rows(spark):
    a = spark.range(1000).withColumn("v", F.col("id") % 7)
    b = a.withColumn("v", F.when(F.col("id") == 500, 99).otherwise(F.col("v")))
    bag = diff.bag_counts(a, b, bucket_rows=4)
    assert bag.count() < 50
    assert counts(a, b, bucket_rows=4) == (1000, 1000, 1, 1, False)


def test_compare_table_by_any_spelling(spark):
    columns = [{"table_name": "Orders", "column_name": "id"}]
    source = Side("left", {"Orders": spark.range(3)}, catalog(spark, tables=[{"table_name": "Orders"}], columns=columns))
    target = Side(
        "right", {"orders": spark.range(2)},
        catalog(spark, tables=[{"table_name": "orders"}], columns=[{**columns[0], "table_name": "orders", "is_nullable": "NO"}]),
    )
    result = diff.compare_table(source, target, " ORDERS ")
    assert (result.source_table, result.target_table) == ("Orders", "orders")
    assert [(r.type, r.object_name) for r in result.structure.collect()] == [("COLUMN_DIFFERENT", "id")]
    assert result.summary.first().only_source_count == 1
    assert [r.id for r in result.samples("source").collect()] == [2]
    back = diff.compare_table(target, source, "orders")
    assert back.summary.first().only_target_count == 1
    with pytest.raises(ValueError, match="has no table"):
        diff.compare_table(source, target, "nothing")
