"""Orphans of whole-number keys by exact bitmaps.

Keys are held 64 to a word: a row ``rule, word, bits`` says which of the keys ``64 * word`` to ``64 * word + 63`` occur. Words are
put together by ``bit_or`` before the shuffle, so dense keys cost a quarter of a byte each and scattered ones no more than the
key itself would; the engine's own bitmaps of 32,768 keys would cost 4 KB for each scattered one. Child minus parent is ``child & ~parent``.
Shifts round down, so negative keys fall into words of their own.

One shuffle handles all foreign keys of all tables: a table is scanned once as a child and once as a parent, whatever the
number of rules it takes part in.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.text import quote_name
from tablecheck.functions.unions import balanced_union
from tablecheck.model import ForeignKey
from tablecheck.operators.skew import broadcast_limit, input_bytes
from tablecheck.sources.checkpoints import Scratch

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
WORD = "shiftright(key, 6)"
BIT = "shiftleft(1L, CAST(key & 63 AS INT))"


def fits(fk: ForeignKey, child: DataFrame, parent: DataFrame) -> bool:
    """Whether the foreign key is one column of whole numbers on both sides."""
    if len(fk.columns) != 1:
        return False
    return isinstance(child.schema[fk.columns[0]].dataType, WHOLE) and isinstance(parent.schema[fk.parent_columns[0]].dataType, WHOLE)


def _keys(tables: Mapping[str, DataFrame], columns: Mapping[str, Mapping[int, str]]) -> list[DataFrame]:
    """``rule, key`` without NULLs, from one scan of each table; ``columns`` names a key column per table and rule."""
    out = []
    for table, rules in columns.items():
        pairs = ", ".join(f"named_struct('rule', {i}, 'key', CAST({quote_name(c, 'mysql')} AS BIGINT))" for i, c in rules.items())
        out.append(tables[table].selectExpr(f"inline(array({pairs}))").filter("key IS NOT NULL"))
    return out


def _by_table(foreign_keys: Mapping[int, ForeignKey], parents: bool) -> dict[str, dict[int, str]]:
    out: dict[str, dict[int, str]] = {}
    for i, fk in foreign_keys.items():
        out.setdefault(fk.parent if parents else fk.table, {})[i] = (fk.parent_columns if parents else fk.columns)[0]
    return out


def orphan_words(tables: Mapping[str, DataFrame], foreign_keys: Mapping[int, ForeignKey]) -> DataFrame:
    """``rule, word, bits``: the child keys that no parent has, of every foreign key, numbered by rule."""
    children = [df.selectExpr("rule", f"{WORD} AS word", f"{BIT} AS child", "0L AS parent") for df in _keys(tables, _by_table(foreign_keys, False))]
    parents = [df.selectExpr("rule", f"{WORD} AS word", "0L AS child", f"{BIT} AS parent") for df in _keys(tables, _by_table(foreign_keys, True))]
    both = balanced_union([*children, *parents]).groupBy("rule", "word").agg(F.bit_or("child").alias("child"), F.bit_or("parent").alias("parent"))
    return both.selectExpr("rule", "word", "child & ~parent AS bits").filter("bits <> 0")


def orphan_keys(words: DataFrame) -> DataFrame:
    """``rule, key``: the keys that words stand for."""
    each = words.select("rule", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    return each.filter("shiftrightunsigned(bits, at) & 1 = 1").selectExpr("rule", "64 * word + at AS key")


def orphan_counts(tables: Mapping[str, DataFrame], foreign_keys: Mapping[int, ForeignKey]) -> DataFrame:
    """``rule_id, n``: rows of each child whose key no parent has; rules without such rows are left out.

    The orphans' words are written when this is called. Where they are below the broadcast threshold, the children's rows are held against
    them in place; beyond it, rows are first counted per key. Tables without orphans are not read a second time.
    """
    if not foreign_keys:
        raise ValueError("There are no foreign keys.")
    spark = next(iter(tables.values())).sparkSession
    words = Scratch(spark).keep(orphan_words(tables, foreign_keys), "orphan-words")
    hit = {r["rule"] for r in words.select("rule").distinct().collect()}  # one number per foreign key
    found = {i: fk for i, fk in foreign_keys.items() if i in hit}
    if not found:
        return spark.createDataFrame([], "rule_id INT, n BIGINT")
    rows = balanced_union(_keys(tables, _by_table(found, False))).withColumn("n", F.lit(1).cast("bigint"))
    if input_bytes(words) <= broadcast_limit(words):
        words = F.broadcast(words)
    else:
        rows = rows.groupBy("rule", "key").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("word", F.expr(WORD)).join(words, ["rule", "word"]).filter(f"bits & {BIT} <> 0")
    return rows.groupBy(F.col("rule").cast("int").alias("rule_id")).agg(F.sum("n").alias("n"))
