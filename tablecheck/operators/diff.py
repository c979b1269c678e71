"""Contents of two tables compared as bags of rows.

One union and one hash aggregate on all columns give the multiplicity of every row on both sides,
hence both directions at once. Copies of a row are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.text import quote_name
from tablecheck.model import SAMPLE_SIZE, Catalog, Side
from tablecheck.operators import structure
from tablecheck.sources.checkpoints import Scratch
from tablecheck.sources.tables import resolve_name


def _family(kind: T.DataType) -> str:
    """Types in one family can hold equal values; values of different families never match."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return kind.simpleString()


def _ident(name: str) -> str:
    return quote_name(name, "mysql")


def column_gate(source: Sequence[str], target: Sequence[str], names=("source", "target")) -> str:
    """'' when the two sides have the same column names, letter case included, else the reason."""
    if set(source) == set(target):
        return ""
    return f"Data was not compared because the columns of {names[0]} and {names[1]} differ."


def _check_names(df: DataFrame) -> None:
    lowered = [c.lower() for c in df.columns]
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    if len(set(lowered)) != len(lowered) and not sensitive:
        raise ValueError("Columns differ in letter case only: set spark.sql.caseSensitive=true to compare them.")


_WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_FLOATS = (T.FloatType, T.DoubleType)


def _decimal_of(kind: T.DataType) -> T.DecimalType | None:
    """The decimal type that holds exactly the values of a whole or decimal type."""
    if isinstance(kind, T.DecimalType):
        return kind
    digits = _WHOLE_DIGITS.get(type(kind))
    return T.DecimalType(digits, 0) if digits else None


def _plain(number: Column) -> Column:
    """A decimal as text that depends on its value only: no exponent, no zeros at the end."""
    text = number.cast("string")
    small = r"^-?(\d)(?:\.(\d+))?E-(\d+)$"
    zeros = F.repeat(F.lit("0"), F.regexp_extract(text, small, 3).cast("int") - 1)
    written = F.concat(
        F.when(number < 0, "-").otherwise(""), F.lit("0."), zeros, F.regexp_extract(text, small, 1), F.regexp_extract(text, small, 2)
    )
    text = F.when(text.rlike(small), written).otherwise(text)
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(number == 0, "0").otherwise(short)


def _exact(value: Column) -> Column:
    """A double as the text of the decimal that it equals, NULL if it equals none of 38 digits.

    The whole part is taken in three limbs of 40 bits. A fraction is a decimal of up to 38 places only if it is a number
    of 2^-38ths, and then it is that number times 5^38 in units of 10^-38; every step on doubles is exact.
    """
    size = F.abs(value)
    # From 2^53 on every double is whole, and from 2^63 on floor would not hold it.
    whole = F.when(size < 2.0**53, F.floor(size).cast("double")).when(size < 1e38, size).otherwise(0.0)
    high = F.floor(whole / 2.0**80).cast("double")
    low = whole - high * 2.0**80
    middle = F.floor(low / 2.0**40).cast("double")
    limbs = ((high, "1208925819614629174706176"), (middle, "1099511627776"), (low - middle * 2.0**40, "1"))
    digits = sum((limb.cast("bigint").cast("decimal(14,0)") * F.lit(unit).cast("decimal(25,0)") for limb, unit in limbs[1:]),
                 limbs[0][0].cast("bigint").cast("decimal(14,0)") * F.lit(limbs[0][1]).cast("decimal(25,0)"))
    part = (size - whole) * 2.0**38
    places = part.cast("bigint").cast("decimal(12,0)") * F.lit(str(5**38)).cast("decimal(27,0)")
    fraction = F.regexp_replace(F.lpad(places.cast("string"), 38, "0"), "0+$", "")
    text = F.concat(F.when(value < 0, "-").otherwise(""), digits.cast("string"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))
    return F.when((size < 1e38) & (part == F.floor(part)), F.when(value == 0, "0").otherwise(text))


def _comparable(column: Column, mine: T.DataType, other: T.DataType) -> Column:
    """The column in a form that makes equal exactly what is equal across the two types."""
    if "variant" in mine.simpleString():
        return F.to_json(column)
    if mine == other:
        return column
    if _family(mine) != _family(other):
        slots = sorted({(_family(mine), mine.simpleString()), (_family(other), other.simpleString())})
        return F.struct(
            *[
                (column if name == _family(mine) else F.lit(None)).cast(kind).alias(f"as_{i}")
                for i, (name, kind) in enumerate(slots)
            ]
        )
    if isinstance(mine, T.BooleanType):
        return column.cast("int")
    whole = tuple(_WHOLE_DIGITS)
    if isinstance(mine, _FLOATS) and isinstance(other, whole):
        value = column.cast("double")
        fits = (value == F.floor(value)) & (value >= -(2.0**63)) & (value < 2.0**63)
        return F.struct(
            F.when(fits, value.cast("bigint")).alias("whole"), F.when(~fits | F.isnan(value), value).alias("rest")
        )
    if isinstance(mine, whole) and isinstance(other, _FLOATS):
        return F.struct(column.cast("bigint").alias("whole"), F.lit(None).cast("double").alias("rest"))
    if isinstance(mine, _FLOATS) and isinstance(other, T.DecimalType):
        value = column.cast("double")
        text = _exact(value)
        return F.struct(text.alias("exact"), F.when(text.isNull(), value).alias("rest"))
    if isinstance(mine, T.DecimalType) and isinstance(other, _FLOATS):
        return F.struct(_plain(column).alias("exact"), F.lit(None).cast("double").alias("rest"))
    here, there = _decimal_of(mine), _decimal_of(other)
    if T.DecimalType in (type(mine), type(other)) and here and there:
        digits, scale = max(d.precision - d.scale for d in (here, there)), max(d.scale for d in (here, there))
        if digits + scale <= T.DecimalType(38, 0).precision:
            return column.cast(T.DecimalType(max(digits + scale, 1), scale))
        return _plain(column.cast(here))
    return column


def aligned(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides projected to the source's columns, in its order, in comparable form."""
    for df in (source, target):
        _check_names(df)
    columns = list(columns or source.columns)
    kinds = [{f.name: f.dataType for f in df.schema.fields} for df in (source, target)]
    out = []
    for df, mine, other in ((source, *kinds), (target, *kinds[::-1])):
        out.append(df.select(*[_comparable(F.col(_ident(c)), mine[c], other[c]).alias(c) for c in columns]))
    return out[0], out[1]


def bag_counts(
    source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, bucket_rows: int = 0
) -> DataFrame:
    """Every distinct row with its number of copies, ``source_rows`` and ``target_rows``.

    With ``bucket_rows`` rows are first summarised per hash bucket of about that many rows, and only those of buckets that
    differ go through the exact aggregate; rows equal on both sides are then left out of the result. That saves the shuffle
    of whole rows when the sides are nearly equal, at the price of further scans.
    Calling two buckets equal rests on their counts and two independent 64-bit sums.
    """
    s, t = aligned(source, target, columns)
    names = s.columns
    both = s.withColumn("__side", F.lit(1)).unionByName(t.withColumn("__side", F.lit(0)))
    if bucket_rows:
        both = _differing_buckets(both, names, bucket_rows)
    return both.groupBy(*[_ident(c) for c in names]).agg(
        F.sum(F.col("__side").cast("bigint")).alias("source_rows"),
        F.sum((1 - F.col("__side")).cast("bigint")).alias("target_rows"),
    )


def _marked(column: Column, kind: T.DataType) -> Column:
    """The value with a flag for NULL at every level, since a hash passes over NULLs, and with the lengths of arrays."""
    parts = [column]
    if isinstance(kind, T.ArrayType):
        parts = [F.size(column), F.transform(column, lambda e: _marked(e, kind.elementType))]
    elif isinstance(kind, T.MapType):
        keys = F.sort_array(F.map_keys(column))
        parts = [F.size(column), F.transform(keys, lambda k: F.struct(k, _marked(F.element_at(column, k), kind.valueType)))]
    elif isinstance(kind, T.StructType):
        parts = [_marked(column[f.name], f.dataType) for f in kind.fields]
    return F.struct(column.isNull(), *parts)


def _differing_buckets(both: DataFrame, names: Sequence[str], bucket_rows: int) -> DataFrame:
    content = [_marked(F.col(_ident(c)), both.schema[c].dataType) for c in names]
    # One row, counted when the query runs: the number of buckets follows the tables.
    total = both.agg(F.greatest(F.ceil(F.count("*") / bucket_rows), F.lit(1)).alias("__buckets"))
    hashed = both.join(F.broadcast(total)).withColumn("__bucket", F.pmod(F.xxhash64(*content), F.col("__buckets"))).drop("__buckets")
    first = F.xxhash64(F.lit(1), *content).cast("decimal(20,0)")
    second = F.xxhash64(F.lit(2), *content).cast("decimal(20,0)")
    sign = F.when(F.col("__side") == 1, 1).otherwise(-1)
    sums = hashed.groupBy("__bucket").agg(
        F.sum(sign.cast("bigint")).alias("n"), F.sum(sign * first).alias("a"), F.sum(sign * second).alias("b")
    )
    changed = sums.filter("n <> 0 OR a <> 0 OR b <> 0").select("__bucket")
    return hashed.join(changed, "__bucket", "left_semi").drop("__bucket")


def excess_rows(bag: DataFrame) -> DataFrame:
    """Rows one side has more often than the other, with the excess per side."""
    spare = F.col("source_rows") - F.col("target_rows")
    return (
        bag.filter("source_rows <> target_rows")
        .withColumn("only_source", F.greatest(spare, F.lit(0)).cast("bigint"))
        .withColumn("only_target", F.greatest(-spare, F.lit(0)).cast("bigint"))
        .drop("source_rows", "target_rows")
    )


def diff_counts(bag: DataFrame) -> DataFrame:
    """One row: rows per side, excess per side, equality."""

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    spare = F.col("source_rows") - F.col("target_rows")
    counted = bag.agg(
        total(F.col("source_rows")).alias("source_row_count"),
        total(F.col("target_rows")).alias("target_row_count"),
        total(F.greatest(spare, F.lit(0))).alias("only_source_count"),
        total(F.greatest(-spare, F.lit(0))).alias("only_target_count"),
    )
    equal = (F.col("only_source_count") == 0) & (F.col("only_target_count") == 0)
    return counted.withColumn("data_compared", F.lit(True)).withColumn("data_equal", equal)


def diff_samples(excess: DataFrame, side: str = "source", size: int = SAMPLE_SIZE) -> DataFrame:
    """The first ``size`` rows (by all columns) that ``side`` has in excess, each as often as in excess.

    ``excess`` comes from :func:`excess_rows`.
    """
    names = [c for c in excess.columns if c not in ("only_source", "only_target")]
    rows = excess.filter(F.col(f"only_{side}") > 0).select(
        *[_ident(c) for c in names], F.least(F.col(f"only_{side}"), F.lit(size)).cast("int").alias("__copies")
    )
    rows = rows.orderBy(*sort_columns(rows.select(*[_ident(c) for c in names]))).limit(size)
    # At most ``size`` rows are left; repeat each and cut again.
    repeated = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    order = sort_columns(repeated.select(*[_ident(c) for c in names]))
    return repeated.orderBy(*order).limit(size).select(*[_ident(c) for c in names])


def sort_columns(df: DataFrame) -> list[Column]:
    """All columns as sort keys; types without an order are sorted by their JSON text."""
    return [
        F.to_json(_ident(f.name)) if any(k in f.dataType.simpleString() for k in ("map<", "variant"))
        else F.col(_ident(f.name))
        for f in df.schema.fields
    ]


def side_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row with the row counts of both sides."""
    zero = F.lit(0).cast("bigint")
    parts = source.agg(F.count("*").alias("s")).withColumn("t", zero).unionByName(
        target.agg(F.count("*").alias("t")).withColumn("s", zero)
    )
    return parts.agg(F.sum("s").alias("source_row_count"), F.sum("t").alias("target_row_count"))


def not_compared(source: DataFrame, target: DataFrame, reason: str) -> DataFrame:
    """The summary when the column gate closes: row counts only."""
    zero = F.lit(0).cast("bigint")
    return side_counts(source, target).select(
        "*", zero.alias("only_source_count"), zero.alias("only_target_count"), F.lit(False).alias("data_compared"),
        F.lit(False).alias("data_equal"), F.lit(reason).alias("data_skip_reason"),
    )


def summarize(excess: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The summary row from the rows in excess; totals come from the tables, which Parquet counts by footers."""
    zero = F.lit(0).cast("bigint")
    found = excess.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_count") for c in ("only_source", "only_target")],
        *[F.coalesce(F.max(zero), zero).alias(f"{side}_row_count") for side in ("source", "target")],
    )
    totals = side_counts(source, target).withColumns({"only_source_count": zero, "only_target_count": zero})
    columns = ("source_row_count", "target_row_count", "only_source_count", "only_target_count")
    equal = (F.col("only_source_count") == 0) & (F.col("only_target_count") == 0)
    return found.unionByName(totals).agg(*[F.sum(c).alias(c) for c in columns]).select(
        "*", F.lit(True).alias("data_compared"), equal.alias("data_equal"), F.lit("").alias("data_skip_reason")
    )


def compare_data(source: DataFrame, target: DataFrame, names=("source", "target"), bucket_rows: int = 0) -> DataFrame:
    """One summary row, whether or not the data could be compared."""
    reason = column_gate(source.columns, target.columns, names)
    if reason:
        return not_compared(source, target, reason)
    bag = bag_counts(source, target, bucket_rows=bucket_rows)
    if bucket_rows:  # the bag then lacks the rows of equal buckets
        return summarize(excess_rows(bag), source, target)
    return diff_counts(bag).withColumn("data_skip_reason", F.lit(""))


@dataclass(frozen=True)
class TableComparison:
    """One table on two sides, under its name on each; every part is computed when asked for."""

    source: Side
    target: Side
    table_name: str
    source_table: str
    target_table: str
    sample_size: int = SAMPLE_SIZE
    bucket_rows: int = 0

    @property
    def names(self) -> tuple[str, str]:
        return self.source.name, self.target.name

    @property
    def source_df(self) -> DataFrame:
        return self.source.tables[self.source_table]

    @property
    def target_df(self) -> DataFrame:
        return self.target.tables[self.target_table]

    @cached_property
    def skip_reason(self) -> str:
        return column_gate(self.source_df.columns, self.target_df.columns, self.names)

    @property
    def columns(self) -> list[str]:
        return [] if self.skip_reason else self.source_df.columns

    @cached_property
    def catalogs(self) -> tuple[Catalog, Catalog]:
        """The table's part of both catalogs, under the source's spelling of its name."""
        other = self.target.catalog.only_table(self.target_table)
        return self.source.catalog.only_table(self.source_table), rename_table(other, self.target_table, self.source_table)

    @cached_property
    def structure(self) -> DataFrame:
        return structure.structure_diff(*self.catalogs, self.names)

    @cached_property
    def excess(self) -> DataFrame | None:
        """Rows in excess on either side, written once to the shared folder, since the summary and both samples start
        from them. The files go with :meth:`close`, or when the session ends."""
        if self.skip_reason:
            return None
        return self._scratch.keep(excess_rows(bag_counts(self.source_df, self.target_df, bucket_rows=self.bucket_rows)), "excess")

    @cached_property
    def _scratch(self) -> Scratch:
        return Scratch(self.source_df.sparkSession)

    def close(self) -> None:
        """Remove the files behind ``excess``; what was computed from it must be done."""
        if "_scratch" in self.__dict__:
            self._scratch.remove()

    @cached_property
    def summary(self) -> DataFrame:
        if self.skip_reason:
            row = not_compared(self.source_df, self.target_df, self.skip_reason)
        else:
            row = summarize(self.excess, self.source_df, self.target_df)
        return row.withColumn("table_name", F.lit(self.source_table))

    def samples(self, side: str) -> DataFrame | None:
        return None if self.skip_reason else diff_samples(self.excess, side, self.sample_size)

    def ddl(self, side: str) -> DataFrame:
        own, name = (self.source, self.source_table) if side == "source" else (self.target, self.target_table)
        return structure.table_ddl(own.catalog.only_table(name))


def compare_table(
    source: Side, target: Side, table: str, size: int = SAMPLE_SIZE, bucket_rows: int = 0
) -> TableComparison:
    """Structure and data of one table; swap the sides to compare in the other direction."""
    if source.catalog is None or target.catalog is None:
        raise ValueError("Both sides need a catalog.")
    wanted = table.strip()
    found = [resolve_name(side.catalog, wanted, side.name) for side in (source, target)]
    return TableComparison(source, target, wanted, *found, size, bucket_rows)


def rename_table(catalog: Catalog, old: str, new: str) -> Catalog:
    """A one-table catalog under the other side's spelling of the name."""
    if old == new:
        return catalog
    parts = {
        kind: getattr(catalog, kind).withColumn("table_name", F.lit(new))
        for kind in ("tables", "columns", "constraints", "indexes", "triggers")
    }
    rest = {k: getattr(catalog, k) for k in ("schemas", "views", "matviews", "sequences", "functions", "extensions")}
    return Catalog(schema=catalog.schema, engine=catalog.engine, **parts, **rest)
