"""Sharding over fixed virtual slots.

A record's id and its text's checksum are hashed into one of ``SLOTS`` slots, whatever the number of shards; of rows that
are equal in both, each is hashed with its place in the input, so that a row repeated without end fills no slot by itself. The bytes of each slot are added up, and
a slot map says which shard holds which slot. The map is a small table of versions: the first deals slots by size, the
largest first, each to the shard with the fewest bytes; ``rebalanced`` edits it, moving slots only out of shards that hold
more than their share, so most records stay where they are.

Both deals are a fold over at most ``SLOTS`` slots in one row. A record's place in its shard is the sum of the slots before
its own plus its number within the slot, so nothing larger than a slot is ever ordered in one task.

NULL texts have no bytes and the checksum of an empty text. A NULL id is hashed as an empty one. Repeated rows are spread over
the slots, which copy goes where depends on the stored rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.staging import staged
from tablecheck.operators.skew import keyed_join

SLOTS = 4096
SHARDS = 16
MAP = "version int, virtual_slot int, shard int, bytes long"


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % slots).cast("int")


def _every_slot(sizes: DataFrame, slots: int) -> DataFrame:
    """``bytes`` of all slots, 0 for those without records."""
    every = sizes.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sizes, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def _folded(slots: DataFrame, shards: int, loads: Column, moved: Column, version: int) -> DataFrame:
    """Deal the slots in ``deck`` order; ``moved`` says (over ``at``, ``load``, ``x``) whether a slot leaves its shard."""
    deck = slots.agg(F.sort_array(F.collect_list(F.struct(F.col("bytes"), (-F.col("virtual_slot")).alias("key"), "shard")), asc=False).alias("deck"))

    def step(acc: Column, x: Column) -> Column:
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        to = F.when(moved(acc["loads"], x), least).otherwise(x["shard"])
        loads_after = F.transform(acc["loads"], lambda v, i: v + F.when(i == to, x["bytes"]).otherwise(0) - F.when(i == x["shard"], x["bytes"]).otherwise(0))
        return F.struct(loads_after.alias("loads"), F.concat(acc["to"], F.array(to)).alias("to"))

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))
    dealt = deck.select("deck", F.aggregate("deck", start, step, lambda acc: acc["to"]).alias("to"))
    flat = dealt.select(F.explode(F.arrays_zip("deck", "to")).alias("z"))
    return flat.select(
        F.lit(version).alias("version"), (-F.col("z.deck.key")).cast("int").alias("virtual_slot"),
        F.col("z.to").alias("shard"), F.col("z.deck.bytes").alias("bytes"),
    )


def first_map(sizes: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: every slot dealt, the largest first."""
    empty = F.array_repeat(F.lit(0).cast("long"), shards)
    deck = _every_slot(sizes, slots).withColumn("shard", F.lit(-1))
    return _folded(deck, shards, empty, lambda loads, x: F.lit(True), 1)


def rebalanced(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for new slot sizes or another number of shards: a slot moves to the emptiest shard if its own holds
    at least the share without half of it, and the other at most the share with half of it. Slots of shards that are no
    more always move."""
    slots = _every_slot(sizes, current.count()).join(current.select("virtual_slot", "shard"), "virtual_slot")
    held = slots.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m"), F.sum("b").alias("total"))
    state = held.first()
    loads = F.array(*[F.lit((state["m"] or {}).get(s, 0)).cast("long") for s in range(shards)])
    share = (state["total"] or 0) / shards

    def moved(load: Column, x: Column) -> Column:
        own, half = F.get(load, x["shard"]), x["bytes"] / 2
        full, room = own - half >= share, F.array_min(load) + half <= share
        return (x["shard"] >= shards) | ((x["bytes"] > 0) & full & room)

    version = current.agg(F.max("version")).first()[0] + 1
    return _folded(slots, shards, loads, moved, version)


def placed(docs: DataFrame, slot_map: DataFrame | None = None, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``size``, ``text_crc32``, ``virtual_slot``, ``map_version``, ``shard``, ``slot``): slot is the place in the shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"),
    )
    key = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    rows = staged(rows.withColumn("copy_key", key), "records")
    repeated = rows.groupBy("copy_key").agg(F.count("*").alias("copies")).filter("copies > 1")
    rows = keyed_join(rows, repeated, ["copy_key"])
    own = F.when(F.col("copies").isNull(), F.col("copy_key")).otherwise(F.concat_ws("/", "copy_key", F.col("place").cast("string")))
    rows = staged(rows.select("id", "size", "text_crc32", virtual_slot(own, slots).alias("virtual_slot")), "placed-records")
    sizes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    chosen = staged(first_map(sizes.drop("n"), shards, slots), "slot-map") if slot_map is None else slot_map
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = chosen.join(sizes.select("virtual_slot", "n"), "virtual_slot").select(
        "virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("text_crc32", "id", "size"))
    return rows.withColumn("number", number).join(starts, "virtual_slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("start") + F.col("number") - 1).alias("slot"),
    )


def publish(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to the stored table; earlier versions stay."""
    slot_map.write.mode("append").parquet(path)


def stored(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the newest by default."""
    versions = spark.read.schema(MAP).parquet(path)
    newest = versions.agg(F.max("version").alias("newest"))
    if version is not None:
        return versions.filter(F.col("version") == version)
    return versions.join(F.broadcast(newest), F.col("version") == F.col("newest")).drop("newest")
