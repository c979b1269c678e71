"""Integrity findings that are kept up to date: files that were checked before are not read again.

For every file of a table, known by its path and time of change, two partial results are stored once:

- ``counts``: per rule on single rows (NULLs, blanks, incomplete foreign keys) the rows that break it;
- ``keys``: per set of columns that some key or foreign key needs, the values with their number of rows.

A run lists the files, reads those that have no partial result yet, adds theirs, and makes all findings from the partial results of the
files that are there now: counts add up, keys are put together by value. Files that were removed or changed drop out by
the same comparison of lists. The findings are those of :func:`tablecheck.operators.integrity.check`.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions.unions import balanced_union
from tablecheck.model import AUDIT_COLUMNS, ForeignKey, RuleSet
from tablecheck.operators import integrity
from tablecheck.operators.integrity import blank_predicate, null_predicate
from tablecheck.operators.skew import _compared_types

#: Tables whose new files are read at the same time.
TABLES_AT_ONCE = 4

COUNTS = "file STRING, changed TIMESTAMP, rule STRING, n BIGINT"
KEYS = "file STRING, changed TIMESTAMP, key_set STRING, key STRING, complete BOOLEAN, n BIGINT"


@dataclass(frozen=True)
class KeySet:
    """Columns of a table whose values are counted, compared in the given types."""

    table: str
    columns: tuple[str, ...]
    types: tuple[str, ...]

    @property
    def name(self) -> str:
        return "|".join(f"{c}:{t}" for c, t in zip(self.columns, self.types))

    def value(self) -> Column:
        """The values as unambiguous text, NULLs included."""
        parts = [F.col(f"`{c}`").cast(t).cast("string").alias(f"c{i}") for i, (c, t) in enumerate(zip(self.columns, self.types))]
        return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


class PartialFindings:
    """Partial results of the tables of one side below ``path``, on a file system that all executors share.

    ``tables`` are folders of Parquet files.
    """

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, str], rules: RuleSet, schema: str = "public", audit: Sequence[str] = AUDIT_COLUMNS):
        self.spark, self.path, self.paths, self.schema, self.audit = spark, path, dict(tables), schema, audit
        self.tables = {t: spark.read.parquet(p) for t, p in self.paths.items()}
        self.rules = integrity.applicable(self.tables, rules)
        self._row_rules: dict[str, dict[str, str]] = {t: {} for t in self.tables}
        self._key_sets: dict[str, set[KeySet]] = {t: set() for t in self.tables}
        for r in self.rules.required:
            self._row_rules[r.table][f"null|{r.column}"] = null_predicate([r.column])
            if r.text:
                self._row_rules[r.table][f"blank|{r.column}"] = blank_predicate(r.column)
        for k in self.rules.keys:
            self._key_sets[k.table].add(self._own(k.table, k.columns))
        for fk in self.rules.foreign_keys:
            if fk.source_nullable:
                self._row_rules[fk.table][self._fk_rule(fk)] = null_predicate(fk.columns)
            if self._has_parent(fk):
                for key_set in self._ends(fk):
                    self._key_sets[key_set.table].add(key_set)

    def _own(self, table: str, columns: Sequence[str]) -> KeySet:
        types = [self.tables[table].schema[c].dataType.simpleString() for c in columns]
        return KeySet(table, tuple(columns), tuple(types))

    def _has_parent(self, fk: ForeignKey) -> bool:
        return fk.parent in self.tables and set(fk.parent_columns) <= set(self.tables[fk.parent].columns)

    def _ends(self, fk: ForeignKey) -> tuple[KeySet, KeySet]:
        """Child and parent columns in the types in which they are compared."""
        types = tuple(_compared_types(self.tables[fk.table], list(fk.columns), self.tables[fk.parent], list(fk.parent_columns)))
        return KeySet(fk.table, tuple(fk.columns), types), KeySet(fk.parent, tuple(fk.parent_columns), types)

    @staticmethod
    def _fk_rule(fk: ForeignKey) -> str:
        return f"null|{'|'.join(fk.columns)}"

    def _stored(self, table: str, part: str, schema: str) -> DataFrame:
        """Partial results of all runs; none before the first."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{part}")
        there = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{part}/*") if there else self.spark.createDataFrame([], schema)

    def _files(self, table: str) -> DataFrame:
        """The table's files as they are now; their content is not read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.paths[table])
        return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"))

    def refresh(self) -> dict[str, list[str]]:
        """Store the partial results of new and changed files, tables side by side; the files that were read, per table."""
        with ThreadPool(TABLES_AT_ONCE) as pool:
            return dict(zip(self.tables, pool.map(self._refresh, self.tables)))

    def _refresh(self, table: str) -> list[str]:
        done = self._stored(table, "files", "file STRING, changed TIMESTAMP")
        fresh = self._files(table).join(done, ["file", "changed"], "left_anti")
        names = sorted(r["file"] for r in fresh.collect())  # one name per new file
        if not names:
            return names
        run = uuid.uuid4().hex
        at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed")]
        rows = self.spark.read.schema(self.tables[table].schema).parquet(*names).select("*", *at)
        if self._row_rules[table]:
            named = [F.expr(f"count_if({p})").alias(f"c{i}") for i, p in enumerate(self._row_rules[table].values())]
            pairs = ", ".join(f"'{r}', c{i}" for i, r in enumerate(self._row_rules[table]))
            counts = rows.groupBy("file", "changed").agg(*named).selectExpr("file", "changed", f"stack({len(named)}, {pairs}) AS (rule, n)")
            counts.withColumn("run", F.lit(run)).write.parquet(f"{self.path}/{table}/counts/{run}")
        if self._key_sets[table]:
            keys = self._key_counts(rows, sorted(self._key_sets[table], key=lambda s: s.name), fresh)
            keys.withColumn("run", F.lit(run)).write.parquet(f"{self.path}/{table}/keys/{run}")
        # Last: a run that fails before this leaves partial results that no list of files names, and the next run has its own.
        fresh.filter(F.col("file").isin(names)).withColumn("run", F.lit(run)).coalesce(1).write.parquet(f"{self.path}/{table}/files/{run}")
        return names

    @staticmethod
    def _key_counts(rows: DataFrame, sets: Sequence[KeySet], files: DataFrame) -> DataFrame:
        """Rows per file and key. Files and sets of columns are numbers until the rows are counted: their names are longer than most keys."""
        each = F.explode(F.array(*[
            F.struct(F.lit(i).alias("__set"), s.value().alias("key"), integrity.all_present(s.columns).alias("complete")) for i, s in enumerate(sets)
        ]))
        counted = rows.select(F.xxhash64("file", "changed").alias("__file"), each.alias("k")).groupBy("__file", "k.__set", "k.key", "k.complete").agg(F.count("*").alias("n"))
        named = F.broadcast(files.select("file", "changed", F.xxhash64("file", "changed").alias("__file")))  # a row per new file
        name = F.element_at(F.array(*[F.lit(s.name) for s in sets]), F.col("__set") + 1)
        return counted.join(named, "__file").select("file", "changed", name.alias("key_set"), "key", "complete", "n")

    def _current(self, table: str, part: str, schema: str) -> DataFrame:
        """Partial results of finished runs for files that are there now as they were then."""
        listed = self._stored(table, "files", "file STRING, changed TIMESTAMP, run STRING").join(self._files(table), ["file", "changed"], "left_semi")
        stored = self._stored(table, part, f"{schema}, run STRING")
        return stored.join(listed, ["file", "changed", "run"])

    def findings(self, include_zero: bool = False) -> DataFrame:
        """All findings from the partial results; call :meth:`refresh` before. No table is read."""
        known = integrity._Rules(self.schema, self.audit)
        parts: list[DataFrame] = []
        keys = {t: self._current(t, "keys", KEYS) for t, sets in self._key_sets.items() if sets}

        def of(key_set: KeySet) -> DataFrame:
            return keys[key_set.table].filter((F.col("key_set") == key_set.name)).groupBy("key", "complete").agg(F.sum("n").alias("n"))

        for table in sorted(self.tables):
            numbers: list[tuple[int, str]] = []
            for r in (r for r in self.rules.required if r.table == table):
                numbers.append((known.nulls(r), f"null|{r.column}"))
                if r.text:
                    numbers.append((known.blanks(r), f"blank|{r.column}"))
            for fk in (f for f in self.rules.foreign_keys if f.table == table):
                if fk.source_nullable:
                    numbers.append((known.fk_nulls(fk), self._fk_rule(fk)))
                if self._has_parent(fk):
                    child, parent = self._ends(fk)
                    lone = of(child).filter("complete").join(of(parent).filter("complete").select("key"), "key", "left_anti")
                    parts.append(lone.agg(F.lit(known.orphans(fk)).alias("rule_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
            if numbers:
                named = self.spark.createDataFrame(numbers, "rule_id INT, rule STRING")
                total = self._current(table, "counts", COUNTS).groupBy("rule").agg(F.sum("n").alias("n"))
                parts.append(named.join(total, "rule", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n")))
        for k in self.rules.keys:
            groups = of(self._own(k.table, k.columns))
            groups = groups.filter("complete") if k.kind == "u" else groups
            parts.append(groups.agg(F.lit(known.duplicates(k)).alias("rule_id"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")))
        counts = balanced_union(parts) if parts else self.spark.createDataFrame([], "rule_id INT, n BIGINT")
        return integrity.findings_of(counts, known, include_zero)
