"""Joins of many rows to a table with one row per key, when one key may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.text import all_present, any_null

#: Without another limit a key is spread over several tasks if its rows hold more than so many advisory partitions.
HOT_PARTITIONS = 4
#: The most keys that are spread: one needs at least this share of all bytes.
HOT_KEYS = 10_000
HOT_BYTES = 0


def _q(name: str) -> str:
    return f"`{name}`"


def input_bytes(df: DataFrame) -> int:
    """Size of everything a plan reads, by Catalyst's statistics.

    For a table with one row per key that is put together by joins on keys this bounds the result,
    where the estimate of the join itself would multiply the sizes of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def broadcast_limit(df: DataFrame) -> int:
    """Bytes up to which Catalyst broadcasts by itself; 0 or less when that is switched off."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def key_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per key among rows whose key is complete; combined before the shuffle."""
    return df.filter(all_present(columns)).groupBy(*[_q(c) for c in columns]).agg(F.count("*").alias("rows_per_key"))


def distinct_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(all_present(columns)).select(*[F.col(_q(c)) for c in columns]).distinct()


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: its texts as they are, other values by their type's usual size."""
    fixed = 8 * len(df.columns)
    texts = [F.coalesce(F.octet_length(_q(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    nested = [
        8 * F.greatest(F.coalesce(F.size(_q(f.name)), F.lit(0)), F.lit(0))
        for f in df.schema.fields if f.dataType.simpleString().startswith(("array", "map"))
    ]
    return reduce(lambda x, y: x + y, texts + nested, F.lit(fixed)).cast("bigint")


def _hot_keys(rows: DataFrame, on: list[str], hot_bytes: int, types: list[str] | None = None) -> DataFrame:
    """``__hot, __salts``: hashes of the keys that hold too much for a task, and over how many they are spread.

    A key needs a 10,000th of all bytes as well, so there are at most HOT_KEYS of them, 12 bytes each.
    """
    if not hot_bytes:
        hot_bytes = HOT_PARTITIONS * _advisory_bytes(rows)
    per_key = rows.filter(all_present(on)).select(_hashed(on, types).alias("__hot"), row_bytes(rows).alias("b")).groupBy("__hot").agg(F.sum("b").alias("b"))
    limit = per_key.agg(F.greatest(F.lit(hot_bytes), F.ceil(F.sum("b") / HOT_KEYS)).alias("__limit"))
    hot = per_key.join(F.broadcast(limit)).filter("b > __limit")
    return hot.select("__hot", F.ceil(F.col("b") / F.col("__limit")).cast("int").alias("__salts"))


def _advisory_bytes(df: DataFrame) -> int:
    value = df.sparkSession.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    return int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value))


def _compared_types(rows: DataFrame, on: list[str], keyed: DataFrame, names: list[str]) -> list[str]:
    """The type in which Catalyst compares each pair of key columns; equal values of unlike types have unlike hashes."""
    types = []
    for c, n in zip(on, names):
        pair = [F.lit(None).cast(df.schema[x].dataType).alias(a) for df, x, a in ((rows, c, "a"), (keyed, n, "b"))]
        equal = rows.sparkSession.range(0).select(*pair).filter(F.col("a") == F.col("b"))
        types.append(equal._jdf.queryExecution().analyzed().condition().left().dataType().sql())
    return types


def _hashed(columns: list[str], types: list[str] | None = None) -> Column:
    return F.xxhash64(*[F.col(_q(c)).cast(t) for c, t in zip(columns, types)] if types else [_q(c) for c in columns])


def keyed_join(
    rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "left", hot_bytes: int = HOT_BYTES,
    force_salt: bool = False,
) -> DataFrame:
    """``rows`` with the other columns of ``keyed``, which has one row per key and the same key columns.

    If what ``keyed`` reads is below the session's broadcast threshold, it is broadcast. Otherwise the bytes of every key
    are added up as part of the same query; rows of a key that holds more than ``hot_bytes`` (by default four advisory
    partitions) are spread over as many salts as that takes, by the partition they come from, and the key's entry in
    ``keyed`` is repeated once per salt; keys are hashed in the type in which they are compared. A rerun task gives the same salts. Rows with an incomplete key match nothing and
    are spread too. Nothing runs before the result is asked for, on either way.
    """
    names = [f"__k{i}" for i in range(len(on))]
    extra = [c for c in keyed.columns if c not in on]
    right = keyed.select(*[F.col(_q(c)).alias(n) for c, n in zip(on, names)], *[_q(c) for c in extra])
    same = [F.col(_q(c)) == F.col(n) for c, n in zip(on, names)]
    columns = [_q(c) for c in rows.columns + extra]
    if not force_salt and 0 < input_bytes(keyed) <= broadcast_limit(rows):
        return rows.join(F.broadcast(right), same, how).select(*columns)

    types = _compared_types(rows, on, right, names)
    hot = _hot_keys(rows, on, hot_bytes, types)

    def with_salts(df: DataFrame, keys: list[str]) -> DataFrame:
        # Bounded by HOT_KEYS rows of two numbers.
        return df.join(F.broadcast(hot), _hashed(keys, types) == F.col("__hot"), "left").drop("__hot")

    part = F.spark_partition_id()
    salt = F.when(any_null(on), part).when(F.col("__salts").isNotNull(), F.pmod(part, F.col("__salts"))).otherwise(0)
    left = with_salts(rows, on).select(*[_q(c) for c in rows.columns], salt.alias("__salt"))
    every = F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)
    right = with_salts(right, names).select(*names, *[_q(c) for c in extra], F.explode(every).alias("__copy"))
    return left.join(right, same + [F.col("__salt") == F.col("__copy")], how).select(*columns)


def lookup(
    rows: DataFrame, columns: list[str], keys: DataFrame, flag: str, hot_bytes: int = HOT_BYTES, force_salt: bool = False
) -> DataFrame:
    """Add ``flag``: whether the row's key (``columns``) is in ``keys`` (distinct, in the same order)."""
    marked = keys.toDF(*columns).withColumn(flag, F.lit(True))
    joined = keyed_join(rows, marked, columns, "left", hot_bytes, force_salt)
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
