"""Strongly connected components of foreign-key graphs: every cycle, not the first one met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.sources.checkpoints import Scratch


def _shuffled(df: DataFrame) -> DataFrame:
    """For the right side of a join: steps are many, and what each of them broadcasts would pass through the driver."""
    return df.hint("merge")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends have both a way in and a way out; others lie on no cycle. Looks one step far."""
    ins, outs = edges.select(F.col("child").alias("node")).distinct(), edges.select(F.col("parent").alias("node")).distinct()
    both = ins.join(_shuffled(outs), "node", "left_semi")
    kept = edges.join(_shuffled(both.withColumnRenamed("node", "parent")), "parent", "left_semi")
    return kept.join(_shuffled(both.withColumnRenamed("node", "child")), "child", "left_semi").select("parent", "child")


def components(edges: DataFrame) -> DataFrame:
    """``component, table`` for all tables on cycles; ``component`` is the smallest table of its cycle or knot of cycles.

    What lies on no cycle is trimmed first, again and again. Then the smallest name that reaches a table is passed forward
    along the edges (only by tables whose name has just changed); a table that keeps its own name is a root, and what reaches the root
    backward among tables of its name is its component. The rest is trimmed and goes round again. Every step is a few joins over all tables at
    once, written to the shared folder, so plans do not grow; the number of steps follows the longest way in the graph.
    References of a table to itself are left out.
    """
    scratch = Scratch(edges.sparkSession)

    def trim(left: DataFrame, n: int) -> tuple[DataFrame, int]:
        while n:
            smaller = scratch.keep(trimmed(left), "edges")
            m = smaller.count()
            if m == n:
                break
            left, n = smaller, m
        return left, n

    left = scratch.keep(edges.select("parent", "child").filter("parent <> child").distinct(), "edges")
    left, n = trim(left, left.count())
    found = []
    while n:
        colors = scratch.keep(left.select(F.col("parent").alias("table")).distinct().withColumn("color", F.col("table")), "colors")
        changed = colors
        while True:
            sent = left.join(_shuffled(changed.select(F.col("table").alias("parent"), "color")), "parent").groupBy(F.col("child").alias("table")).agg(F.min("color").alias("sent"))
            better = colors.join(_shuffled(sent), "table").filter("sent < color").select("table", F.col("sent").alias("color"))
            changed = scratch.keep(better, "changed")
            if changed.isEmpty():
                break
            merged = colors.join(_shuffled(changed.withColumnRenamed("color", "new")), "table", "left")
            colors = scratch.keep(merged.select("table", F.coalesce("new", "color").alias("color")), "colors")
        inside = left.join(_shuffled(colors.select(F.col("table").alias("parent"), "color")), "parent")
        inside = inside.join(_shuffled(colors.select(F.col("table").alias("child"), F.col("color").alias("child_color"))), "child")
        inside = scratch.keep(inside.filter("color = child_color").select("parent", "child", "color"), "inside")
        members = scratch.keep(colors.filter("table = color").select("table", "color"), "members")
        fresh = members
        while True:
            back = inside.join(_shuffled(fresh.select(F.col("table").alias("child"), "color")), ["child", "color"]).select(F.col("parent").alias("table"), "color").distinct()
            fresh = scratch.keep(back.join(_shuffled(members), ["table", "color"], "left_anti"), "fresh")
            if fresh.isEmpty():
                break
            members = scratch.keep(members.unionByName(fresh), "members")
        found.append(members)
        rest = inside.join(_shuffled(members.select(F.col("table").alias("parent"))), "parent", "left_anti")
        rest = rest.join(_shuffled(members.select(F.col("table").alias("child"))), "child", "left_anti").select("parent", "child")
        left = scratch.keep(rest, "edges")
        left, n = trim(left, left.count())
    if not found:
        return edges.limit(0).select(F.col("parent").alias("component"), F.col("parent").alias("table"))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    whole = whole.select(F.col("color").alias("component"), "table")
    # A root alone lies on no cycle.
    several = whole.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return scratch.keep(whole.join(_shuffled(several), "component", "left_semi"), "components")
