"""Rules for the sample tables and the changes that make a target side out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.model import ForeignKey, Key, Required, RuleSet

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

PRIMARY_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}
UNIQUE = {"documents": "text", "part": "p_name", "pages": "url"}
TEXT = {
    "region": ("r_name",), "nation": ("n_name",), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",),
    "part": ("p_name", "p_brand", "p_type"), "orders": ("o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_returnflag", "l_linestatus"),
}
FOREIGN_KEYS = (
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events_customer", "events", "user_id", "customer", "c_custkey"),
    ("labels_documents", "labels", "doc_id", "documents", "doc_id"),
)
NULLABLE = ("o_custkey", "user_id")


def rules() -> RuleSet:
    required = [Required(t, c) for t, columns in PRIMARY_KEYS.items() for c in columns]
    required += [Required(t, c, text=True) for t, columns in TEXT.items() for c in columns]
    required.append(Required("events", "ts"))
    keys = [Key(f"{t}_pkey", t, columns) for t, columns in PRIMARY_KEYS.items()]
    keys += [Key(f"{t}_{c}_key", t, (c,), "u") for t, c in UNIQUE.items()]
    foreign = []
    for name, table, column, parent, parent_column in FOREIGN_KEYS:
        nullable = (column,) if column in NULLABLE else ()
        foreign.append(ForeignKey(name, table, (column,), parent, (parent_column,), nullable, nullable))
    return RuleSet(tuple(required), tuple(keys), tuple(foreign))


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names or TABLES}


# The changes below stand for damage on the target side. They cover the whole table: each row of
# the source is kept, altered, lost or doubled by a rule on its key.

def orders_target(orders: DataFrame) -> DataFrame:
    """Some orders lost, some with another price, some doubled with their first price."""
    key = F.col("o_orderkey")
    kept = orders.filter(key % 97 != 0).withColumn(
        "o_totalprice", F.when(key % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return kept.unionByName(orders.filter(key % 103 == 0))


def orders_parents(orders: DataFrame) -> DataFrame:
    """Orders with some lost, as parents of lineitem."""
    return orders.filter(F.col("o_orderkey") % 97 != 0)


def orders_nulls(orders: DataFrame) -> DataFrame:
    """Orders with missing customers and priorities and with blank statuses."""
    key = F.col("o_orderkey")
    return (
        orders.withColumn("o_custkey", F.when(key % 89 != 0, F.col("o_custkey")))
        .withColumn("o_orderstatus", F.when(key % 83 == 0, "  ").otherwise(F.col("o_orderstatus")))
        .withColumn("o_orderpriority", F.when(key % 79 != 0, F.col("o_orderpriority")))
    )


def target_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The target side for a full integrity run: damaged orders, everything else as it is."""
    return {**tables, "orders": orders_nulls(orders_parents(tables["orders"]))}
