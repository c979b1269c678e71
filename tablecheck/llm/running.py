"""Running sums over whole tables without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablecheck.llm.staging import staged


def before(rows: DataFrame, order: list[str | Column], value: str, name: str, group: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (long) over all rows before, within ``group`` (a long, not NULL).

    ``order`` must be total, so that many equal keys are dealt to several tasks; it and ``group`` decide the ranges in which
    rows are dealt. A task adds up its own rows; what lies before a task comes from one total per task and group. The sorted
    rows are written once.
    """
    keys = [*([group] if group else []), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = [StructField("__part", IntegerType()), StructField("__inner", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = np.asarray(batch.column(value), dtype=np.int64)
            ends = np.cumsum(size)
            of = np.asarray(batch.column(group), dtype=np.int64) if group else np.zeros(n, dtype=np.int64)
            first = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
            base = (ends - size)[first]  # what came before each group in this batch
            if of[0] == last:
                base[0] -= carry
            inner = ends - size - np.repeat(base, np.diff(np.r_[first, n]))
            last, carry = of[-1], int(inner[-1] + size[-1])
            columns = [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(inner)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__inner"])

    kept = staged(ranged.mapInArrow(run, StructType([*rows.schema.fields, *fields])), "running")
    by = ["__part", *([group] if group else [])]
    totals = kept.groupBy(*by).agg(F.sum(value).alias("__n"))
    # One row per task here, in each group.
    window = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, F.coalesce(F.sum("__n").over(window), F.lit(0)).alias("__start"))
    return kept.join(starts, by).select(*[f"`{c}`" for c in rows.columns], (F.col("__start") + F.col("__inner")).alias(name))
