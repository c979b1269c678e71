"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key -ln(u) / w, u decided by its id and a seed, w its quality weight; smaller keys come first. A
source with target t and size s is taken floor(t / s) times whole; the rest of the target is filled in the order of the
keys, to the document with which the words taken come nearest to it. Targets share all words by weight, none above
``most`` times its source's size; what is cut off goes to the others by weight.

The prefix sums need no source in one task: keys are dealt monotonously into bins, sizes are added up per source and bin,
a window over the bins (at most ``BINS`` a source) gives each bin its offset, and the rows of one bin are sorted among
themselves. One row per source is ordered in a single task to give weights and targets.

NULL texts have size zero, and rows of size zero are taken in complete epochs only. A NULL source is a source, the last one. NULL, negative
or NaN quality weights count as one; zero comes after all others. Equal keys are ordered by id and size; rows equal in all
of these are interchangeable. Other columns of any name are carried in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.columns import unit, words
from tablecheck.llm.staging import staged

#: Bins of a source. More bins make shorter sorts and a longer table of offsets.
BINS = 4096
#: Quality weights of documents labelled good, labelled bad, and not labelled.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def targets(sizes: DataFrame, weight: Column, most: float) -> DataFrame:
    """``target`` per row of (``src``, ``source_size``); ``weight`` may use ``rank``, the source's place from 0.

    Sources meet their limit in the order of limit over weight. If the first k are cut off, the others share what is left
    by weight; the right k is the first at which the next source stays within its limit.
    """
    ordered = sizes.withColumn("rank", F.row_number().over(Window.orderBy("src")) - 1).withColumn("weight", weight)
    fill = Window.orderBy(F.col("source_size") * most / F.col("weight"), "src")
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    level = ordered.withColumn("level", left / F.sum("weight").over(rest).cast("double"))
    fits = level.withColumn("fits", F.col("weight") * F.col("level") <= F.col("source_size") * most)
    final = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") * most / F.col("weight"), "src", "level"))).over(all_rows)["level"]
    return fits.withColumn("final", final).select(
        "src", "source_size",
        F.coalesce(F.least(F.col("weight") * F.col("final"), F.col("source_size") * F.lit(float(most))), F.lit(0.0)).alias("target"),
    )


def taken(
    docs: DataFrame, quality: DataFrame | None = None, weight: Column | None = None, most: int = 3, seed: str = "mix-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(id, ``source``, ``size``, ``source_size``, ``target``, ``copies``) for every row of the documents.

    ``quality`` has (``doc_id``, ``q``) at most once per id; without it all weigh the same. ``weight`` is an expression
    over ``rank``; by default 1, 2, 3 and again.
    """
    weight = F.col("rank") % 3 + 1 if weight is None else weight
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"),
    )
    if quality is not None:
        rows = rows.join(quality.select(F.col("doc_id").alias("qid"), "q"), F.col("id") == F.col("qid"), "left").drop("qid")
    else:
        rows = rows.withColumn("q", F.lit(None).cast("double"))
    good = F.when((F.col("q") >= 0) & ~F.isnan("q"), F.col("q")).otherwise(1.0)
    src = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    key = F.when(good == 0, F.lit(float("inf"))).otherwise(-F.log(unit(F.lit(seed), F.col("id"))) / good)
    rows = rows.select("id", "source", "size", src.alias("src"), key.alias("key"))
    rows = staged(rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * BINS), F.lit(BINS - 1)).cast("int")), "sizes")

    bins = rows.groupBy("src", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(bins.groupBy("src").agg(F.sum("bin_size").alias("source_size")), weight, most)
    earlier = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("src", "bin", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("offset"))
    offsets = staged(offsets.join(goal, "src"), "offsets")

    inside = Window.partitionBy("src", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["src", "bin"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.col("target") - whole * F.col("source_size")
    # A document is taken once more while at least half of it fits: the sum then ends nearest to the budget.
    more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= budget)
    copies = (whole + more.cast("int")).cast("int").alias("copies")
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies)


def labelled_quality(labels: DataFrame) -> DataFrame:
    """One weight per labelled id: the best label counts. Ids without a label have none."""
    best = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") > 0, GOOD).otherwise(BAD).alias("q"))


def mixed(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The documents as the mix holds them: each row as often as it is taken, with its own columns.

    Rows are joined to their copies by id and text, so rows that repeat both are counted together and share their copies.
    """
    row = docs.select(F.struct("*").alias("doc"))
    keyed = row.select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.source").alias("source"))
    chosen = taken(keyed.select("doc_id", "text", "source"), quality, **options)
    size = F.size(words(F.col("text"))).cast("long")
    per = chosen.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    order = Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text"))
    numbered = keyed.withColumn("size", size).withColumn("n", F.row_number().over(order))
    same = [numbered[c].eqNullSafe(per[c]) for c in ("doc_id", "source", "size")]
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("n") <= F.col("copies") % F.col("rows")).cast("int")
    both = numbered.join(per, same[0] & same[1] & same[2]).withColumn("times", times).filter("times > 0")
    return both.select("doc", F.explode(F.expr("sequence(1, CAST(times AS INT))"))).select("doc.*")
