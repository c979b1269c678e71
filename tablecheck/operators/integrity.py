"""Integrity of the target's data under the rules the source declares.

Nulls, blanks and incomplete foreign keys of a table are counted in one aggregate over one scan.
Orphans and duplicates first count rows per key, which is combined before the shuffle, so a key that
holds a large share of the rows reaches its task as one row per mapper.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecheck.functions.text import all_present, any_null, qualify_name, quote_name
from tablecheck.model import (
    AUDIT_COLUMNS, FINDING_COLUMNS, IMPACTS, REVIEW_LIMIT, TEXT_TYPES, Catalog, ForeignKey, Key, Required, RuleSet,
)
from tablecheck.functions.unions import balanced_union
from tablecheck.operators import keybits
from tablecheck.operators.diff import sort_columns
from tablecheck.operators.skew import HOT_BYTES, broadcast_limit, distinct_keys, input_bytes, key_counts, keyed_join, lookup

# Order in which a full run reports the kinds of finding.
STAGES = ("REQUIRED_NULL_VALUES", "FK_NULL_RELATION", "FK_ORPHAN_ROWS", "DUPLICATE_KEY_VALUES", "REQUIRED_EMPTY_TEXT")


META_DDL = (
    "rule_id INT, stage INT, type STRING, impact STRING, impact_rank INT, rule_name STRING, table_name STRING, "
    "columns ARRAY<STRING>, impact_reason STRING, before STRING, after STRING, review_sql STRING, fix_sql STRING"
)


def _tick(name: str) -> str:
    return quote_name(name, "mysql")


def null_predicate(columns: Sequence[str]) -> str:
    return " OR ".join(f"{_tick(c)} IS NULL" for c in columns)


def blank_predicate(column: str) -> str:
    """Nothing but U+0020; other white space counts as content."""
    return f"trim({_tick(column)}) = ''"


class _Texts:
    """Review and repair statements, which name tables of the side under review."""

    def __init__(self, schema: str):
        self.schema = schema

    def table(self, name: str) -> str:
        return qualify_name(self.schema, name)

    def nulls(self, table: str, columns: Sequence[str]) -> str:
        where = " OR ".join(f"{quote_name(c)} IS NULL" for c in columns)
        return f"SELECT * FROM {self.table(table)} WHERE {where} LIMIT {REVIEW_LIMIT};"

    def blanks(self, table: str, column: str) -> str:
        return f"SELECT * FROM {self.table(table)} WHERE btrim({quote_name(column)}) = '' LIMIT {REVIEW_LIMIT};"

    def _orphan_condition(self, fk: ForeignKey, gap: str) -> str:
        present = " AND ".join(f"c.{quote_name(c)} IS NOT NULL" for c in fk.columns)
        match = " AND ".join(
            f"p.{quote_name(p)} = c.{quote_name(c)}" for c, p in zip(fk.columns, fk.parent_columns)
        )
        return f"{present}{gap}AND NOT EXISTS (SELECT 1 FROM {self.table(fk.parent)} p WHERE {match})"

    def orphans(self, fk: ForeignKey) -> str:
        return f"SELECT c.* FROM {self.table(fk.table)} c WHERE {self._orphan_condition(fk, ' ')} LIMIT {REVIEW_LIMIT};"

    def orphan_fix(self, fk: ForeignKey) -> str:
        if set(fk.columns) - set(fk.target_nullable):
            return (
                "-- No automatic fix: not every column of the foreign key accepts NULL. "
                "Insert the missing parent or point the rows at an existing one."
            )
        cleared = ", ".join(f"{quote_name(c)} = NULL" for c in fk.columns)
        return f"UPDATE {self.table(fk.table)} c\nSET {cleared}\nWHERE {self._orphan_condition(fk, chr(10) + '  ')};"

    def duplicates(self, key: Key) -> str:
        columns = ", ".join(quote_name(c) for c in key.columns)
        where = ""
        if key.kind == "u":
            where = "WHERE " + " AND ".join(f"{quote_name(c)} IS NOT NULL" for c in key.columns) + " "
        return (
            f"SELECT {columns}, COUNT(*) AS duplicate_rows FROM {self.table(key.table)} {where}GROUP BY {columns} "
            f"HAVING COUNT(*) > 1 ORDER BY duplicate_rows DESC LIMIT {REVIEW_LIMIT};"
        )


def _fk_impact(fk: ForeignKey, impact: str, reason: str, audit: Sequence[str]) -> tuple[str, str]:
    """Relations that only record who changed a row do not bear on functional integrity."""
    hit = sorted(set(fk.columns) & set(audit))
    if hit:
        return "LOW", f"Audit relation by {hit[0]}: not relevant to functional integrity."
    return impact, reason


class _Rules:
    """Texts of the findings, numbered; the counts computed on Spark refer to them by number."""

    def __init__(self, schema: str, audit: Sequence[str]):
        self.texts = _Texts(schema)
        self.audit = audit
        self.rows: list[tuple] = []

    def _add(self, kind, impact, rule, table, columns, reason, before, after, review, fix="") -> int:
        self.rows.append((
            len(self.rows), STAGES.index(kind) + 1, kind, impact, IMPACTS.index(impact) + 1, rule, table,
            list(columns), reason, before, after, review, fix,
        ))
        return len(self.rows) - 1

    def nulls(self, r: Required) -> int:
        return self._add(
            "REQUIRED_NULL_VALUES", "CRITICAL", r.column, r.table, [r.column],
            "These rows break NOT NULL and whatever depends on the column.",
            f"Required column '{r.table}.{r.column}' is NULL in ", " row(s) of the target.",
            self.texts.nulls(r.table, [r.column]),
        )

    def blanks(self, r: Required) -> int:
        return self._add(
            "REQUIRED_EMPTY_TEXT", "MEDIUM", r.column, r.table, [r.column],
            "Not NULL, yet blank text in a required column usually means incomplete data.",
            f"Required text column '{r.table}.{r.column}' is blank in ", " row(s).",
            self.texts.blanks(r.table, r.column),
        )

    def fk_nulls(self, fk: ForeignKey) -> int:
        impact, reason = _fk_impact(
            fk, "HIGH", "The schema allows it, but rows without the relation may lack their parent.", self.audit
        )
        return self._add(
            "FK_NULL_RELATION", impact, fk.name, fk.table, fk.columns, reason,
            f"Relation '{fk.name}' of '{fk.table}' has ", " row(s) with NULL in its columns.",
            self.texts.nulls(fk.table, fk.columns),
        )

    def orphans(self, fk: ForeignKey) -> int:
        impact, reason = _fk_impact(fk, "CRITICAL", "These rows break the foreign key.", self.audit)
        return self._add(
            "FK_ORPHAN_ROWS", impact, fk.name, fk.table, fk.columns, reason, f"Relation '{fk.name}' has ",
            f" row(s) in '{fk.table}' without a parent in '{fk.parent}'.", self.texts.orphans(fk),
            self.texts.orphan_fix(fk),
        )

    def duplicates(self, key: Key) -> int:
        return self._add(
            "DUPLICATE_KEY_VALUES", "CRITICAL", key.name, key.table, key.columns,
            "Duplicates break the key and may stand for one entity twice.",
            f"Key '{key.name}' of '{key.table}' has ", " surplus duplicate row(s).", self.texts.duplicates(key),
        )


def predicate_counts(df: DataFrame, predicates: Mapping[int, str]) -> DataFrame:
    """``rule_id, n``: rows of one table that meet each predicate, from one aggregate over one scan."""
    counted = df.selectExpr(*[f"count_if({p}) AS c{i}" for i, p in predicates.items()])
    pairs = ", ".join(f"{i}, c{i}" for i in predicates)
    return counted.selectExpr(f"stack({len(predicates)}, {pairs}) AS (rule_id, n)")


def parent_lookup(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Distinct complete keys of the child that no parent row has, with their number of rows.

    Both sides are one row per key before they meet, so neither a frequent child nor a repeated parent fills a task.
    """
    counts = key_counts(child, list(fk.columns))
    keys, on = _parent_keys(fk, parent)
    return counts.join(keys, on, "left_anti")


def _parent_keys(fk: ForeignKey, parent: DataFrame, tag: str = "p") -> tuple[DataFrame, list[Column]]:
    """Distinct keys of the parent under names of their own, and the condition that joins a child to them."""
    names = [f"__{tag}{i}" for i in range(len(fk.columns))]
    keys = parent.select(*[F.col(f"`{p}`").alias(n) for p, n in zip(fk.parent_columns, names)]).distinct()
    return keys, [F.col(f"`{c}`") == F.col(n) for c, n in zip(fk.columns, names)]


def orphan_count(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """``n``: rows of the child whose complete key no parent has."""
    return parent_lookup(child, fk, parent).selectExpr("coalesce(sum(rows_per_key), 0) AS n")


def duplicate_groups(df: DataFrame, key: Key) -> DataFrame:
    """Key values of more than one row; UNIQUE ignores rows with a NULL, a primary key does not."""
    rows = df.filter(all_present(key.columns)) if key.kind == "u" else df
    grouped = rows.groupBy(*[f"`{c}`" for c in key.columns]).agg(F.count("*").alias("duplicate_rows"))
    return grouped.filter("duplicate_rows > 1")


def duplicate_count(df: DataFrame, key: Key) -> DataFrame:
    """``n``: rows beyond the first of each key value."""
    return duplicate_groups(df, key).selectExpr("coalesce(sum(duplicate_rows - 1), 0) AS n")


def key_groups(df: DataFrame, keys: Sequence[Key]) -> tuple[DataFrame, list[Column]]:
    """Values of all keys of a table that occur more than once, ``duplicate_rows`` times, and per key which groups are its own.

    All keys are grouping sets of one aggregate: one scan, one Expand and one shuffle, in which rows are counted before it.
    A group of a UNIQUE key with a NULL is none of its own; rows with a NULL reach the shuffle as one row per mapper and set.
    """
    columns = sorted({c for k in keys for c in k.columns})
    sets = sorted({tuple(sorted(k.columns)) for k in keys})
    grouped = df.groupingSets([[_tick(c) for c in s] for s in sets], *[_tick(c) for c in columns])
    groups = grouped.agg(F.grouping_id().alias("__set"), F.count("*").alias("duplicate_rows")).filter("duplicate_rows > 1")
    own = []
    for k in keys:
        number = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in k.columns)
        own.append((F.col("__set") == number) & (all_present(k.columns) if k.kind == "u" else F.lit(True)))
    return groups, own


def duplicate_counts(df: DataFrame, keys: Mapping[int, Key]) -> DataFrame:
    """``rule_id, n``: rows beyond the first of each value, for all keys of a table."""
    groups, own = key_groups(df, list(keys.values()))
    surplus = F.col("duplicate_rows") - 1
    counted = groups.agg(*[F.coalesce(F.sum(F.when(o, surplus)), F.lit(0)).alias(f"c{i}") for i, o in zip(keys, own)])
    pairs = ", ".join(f"{i}, c{i}" for i in keys)
    return counted.selectExpr(f"stack({len(keys)}, {pairs}) AS (rule_id, n)")


def check(
    tables: Mapping[str, DataFrame], rules: RuleSet, schema: str = "public",
    audit: Sequence[str] = AUDIT_COLUMNS, include_zero: bool = False, kinds: Sequence[str] = STAGES, bitmaps: bool = False,
) -> DataFrame:
    """All findings on the given tables as one lazy frame; ``kinds`` narrows the run.

    Rules about tables or columns the side does not have are skipped. With ``bitmaps`` orphans of whole-number keys are
    found by :mod:`tablecheck.operators.keybits`, which writes the orphans' bitmaps when this is called.
    """
    rules = applicable(tables, rules)
    known = _Rules(schema, audit)
    parts: list[DataFrame] = []
    whole: dict[int, ForeignKey] = {}
    for table in sorted(tables):
        rows, predicates = tables[table], {}
        for r in (r for r in rules.required if r.table == table):
            if "REQUIRED_NULL_VALUES" in kinds:
                predicates[known.nulls(r)] = null_predicate([r.column])
            if r.text and "REQUIRED_EMPTY_TEXT" in kinds:
                predicates[known.blanks(r)] = blank_predicate(r.column)
        for fk in (f for f in rules.foreign_keys if f.table == table):
            if fk.source_nullable and "FK_NULL_RELATION" in kinds:
                predicates[known.fk_nulls(fk)] = null_predicate(fk.columns)
            if "FK_ORPHAN_ROWS" not in kinds or fk.parent not in tables or not set(fk.parent_columns) <= set(tables[fk.parent].columns):
                continue
            number = known.orphans(fk)
            if bitmaps and keybits.fits(fk, tables[table], tables[fk.parent]):
                whole[number] = fk
                continue
            keys, on = _parent_keys(fk, tables[fk.parent], f"p{number}_")
            if 0 < input_bytes(keys) <= broadcast_limit(rows):
                # What the parent's files hold is small: its keys travel to the child's one scan.
                flag = f"__fk{number}"
                rows = rows.join(F.broadcast(keys.withColumn(flag, F.lit(True))), on, "left")
                predicates[number] = f"NOT ({null_predicate(fk.columns)}) AND {flag} IS NULL"
            else:
                counted = orphan_count(tables[table], tables[fk.parent], fk)
                parts.append(counted.selectExpr(f"{number} AS rule_id", "n"))
        if predicates:
            parts.append(predicate_counts(rows, predicates))
    if whole:
        counted = keybits.orphan_counts(tables, whole)
        if include_zero:
            zero = counted.sparkSession.createDataFrame([(i, 0) for i in whole], "rule_id INT, n BIGINT")
            counted = counted.unionAll(zero).groupBy("rule_id").agg(F.sum("n").alias("n"))
        parts.append(counted)
    if "DUPLICATE_KEY_VALUES" in kinds:
        keyed: dict[str, dict[int, Key]] = {}
        for key in rules.keys:
            keyed.setdefault(key.table, {})[known.duplicates(key)] = key
        parts += [duplicate_counts(tables[table], own) for table, own in keyed.items()]
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    counts = balanced_union(parts) if parts else spark.createDataFrame([], "rule_id INT, n BIGINT")
    return findings_of(counts, known, include_zero)


def findings_of(counts: DataFrame, known: _Rules, include_zero: bool = False) -> DataFrame:
    """Findings from ``rule_id, n`` and the texts of the numbered rules."""
    if not include_zero:
        counts = counts.filter("n > 0")
    # One row per rule on both sides.
    found = counts.join(counts.sparkSession.createDataFrame(known.rows, META_DDL), "rule_id").withColumnRenamed("n", "count")
    return found.withColumn("description", F.concat("before", F.col("count").cast("string"), "after")).select(
        *FINDING_COLUMNS
    )


def applicable(tables: Mapping[str, DataFrame], rules: RuleSet) -> RuleSet:
    def has(table: str, columns: Sequence[str]) -> bool:
        return table in tables and set(columns) <= set(tables[table].columns)

    return RuleSet(
        tuple(r for r in rules.required if has(r.table, [r.column])),
        tuple(k for k in rules.keys if has(k.table, k.columns)),
        tuple(f for f in rules.foreign_keys if has(f.table, f.columns)),
    )


def catalog_rules(source: Catalog, target: Catalog) -> DataFrame:
    """Every rule the source catalog declares, and whether the target has what it speaks of.

    ``kind, rule_name, table_name, columns, parent, parent_columns, source_nullable,
    target_nullable, text, applicable``.
    """
    c = F.col
    nothing = F.array().cast("array<string>")
    required = source.columns.filter("is_nullable = 'NO'").select(
        F.lit("required").alias("kind"), c("column_name").alias("rule_name"), "table_name",
        F.array("column_name").alias("columns"), F.lit("").alias("parent"), nothing.alias("parent_columns"),
        c("data_type").isin(*TEXT_TYPES).alias("text"),
    )
    keyed = source.constraints.filter(c("constraint_type").isin("p", "u", "f")).select(
        c("constraint_type").alias("kind"), c("constraint_name").alias("rule_name"), "table_name", "columns",
        F.coalesce("referenced_table", F.lit("")).alias("parent"),
        F.coalesce("referenced_columns", nothing).alias("parent_columns"), F.lit(False).alias("text"),
    )
    # Columns per table: bounded by the width of a table.
    per_side = [
        cat.columns.select("table_name", "column_name", "is_nullable").repartition("table_name").groupBy("table_name").agg(
            F.collect_list("column_name").alias(f"{n}_all"),
            F.collect_list(F.when(c("is_nullable") == "YES", c("column_name"))).alias(f"{n}_nullable"),
        )
        for n, cat in (("source", source), ("target", target))
    ]
    known = target.tables.select("table_name").join(per_side[1], "table_name", "left")
    parents = known.select(c("table_name").alias("parent"), c("target_all").alias("parent_all"))
    # Most foreign keys may refer to one table. Other rules have no parent and are spared this join.
    foreign = keyed_join(keyed.filter("kind = 'f'"), parents, ["parent"])
    others = required.unionByName(keyed.filter("kind <> 'f'")).withColumn("parent_all", F.lit(None).cast("array<string>"))
    rules = others.unionByName(foreign).join(per_side[0].drop("source_all"), "table_name", "left")
    rules = rules.join(known.withColumn("__t", F.lit(True)), "table_name", "left")

    def missing(columns: str, have: str) -> Column:
        return F.size(F.array_except(columns, F.coalesce(c(have), nothing))) > 0

    fits = F.coalesce(c("__t"), F.lit(False)) & ~missing("columns", "target_all")
    parent_fits = (c("kind") != "f") | ~missing("parent_columns", "parent_all")
    return rules.select(
        "kind", "rule_name", "table_name", "columns", "parent", "parent_columns",
        F.array_intersect("columns", F.coalesce("source_nullable", nothing)).alias("source_nullable"),
        F.array_intersect("columns", F.coalesce("target_nullable", nothing)).alias("target_nullable"),
        "text", fits.alias("applicable"), (fits & parent_fits).alias("parent_applicable"),
    )


def rules_from_catalogs(source: Catalog, target: Catalog) -> RuleSet:
    """The applicable rules as plan-building metadata (one small row per declared rule)."""
    rows = catalog_rules(source, target).filter("applicable").collect()
    rows.sort(key=lambda r: (r.table_name, r.rule_name))
    return RuleSet(
        tuple(Required(r.table_name, r.columns[0], r.text) for r in rows if r.kind == "required"),
        tuple(Key(r.rule_name, r.table_name, tuple(r.columns), r.kind) for r in rows if r.kind in ("p", "u")),
        tuple(
            ForeignKey(
                r.rule_name, r.table_name, tuple(r.columns), r.parent, tuple(r.parent_columns),
                tuple(r.source_nullable), tuple(r.target_nullable),
            )
            for r in rows
            if r.kind == "f"
        ),
    )


def review_nulls(df: DataFrame, columns: Sequence[str], limit: int = REVIEW_LIMIT) -> DataFrame:
    """Rows with NULL in any of the columns."""
    return _first(df.filter(any_null(columns)), limit)


def review_blanks(df: DataFrame, column: str, limit: int = REVIEW_LIMIT) -> DataFrame:
    return _first(df.filter(blank_predicate(column)), limit)


def orphan_rows(child: DataFrame, parent: DataFrame, fk: ForeignKey, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """The whole child rows whose complete key no parent has."""
    flagged = lookup(child, list(fk.columns), distinct_keys(parent, list(fk.parent_columns)), "__has_parent", hot_bytes)
    return flagged.filter(all_present(fk.columns) & ~F.col("__has_parent")).drop("__has_parent")


def review_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey, limit: int = REVIEW_LIMIT) -> DataFrame:
    return _first(orphan_rows(child, parent, fk), limit)


def review_duplicates(df: DataFrame, key: Key, limit: int = REVIEW_LIMIT) -> DataFrame:
    """The keys with most rows."""
    groups = duplicate_groups(df, key)
    return groups.orderBy(F.desc("duplicate_rows"), *sort_columns(groups.drop("duplicate_rows"))).limit(limit)


def _texts_of(names: Sequence[str]) -> Column:
    return F.array(*[F.col(_tick(c)).cast("string") for c in names])


def samples(
    tables: Mapping[str, DataFrame], rules: RuleSet, limit: int = REVIEW_LIMIT, kinds: Sequence[str] = STAGES,
) -> DataFrame:
    """``type, rule_name, table_name, place, names, sample``: up to ``limit`` rows for every rule that is broken.

    A table is scanned once for all rules on its rows and once for all its keys. Rows that break none leave at the scan; the others
    appear once per rule they break, and of each rule every task passes on its first ``limit`` by all columns (of
    duplicates, the keys with most rows), so no more than that of any rule meets in one place. ``sample`` has the values as
    text, under ``names``; for duplicates the key and its number of rows.
    """
    rules = applicable(tables, rules)
    parts: list[DataFrame] = []
    for table in sorted(tables):
        rows, broken = tables[table], {}
        for r in (r for r in rules.required if r.table == table):
            broken["REQUIRED_NULL_VALUES", r.column] = null_predicate([r.column])
            if r.text:
                broken["REQUIRED_EMPTY_TEXT", r.column] = blank_predicate(r.column)
        for fk in (f for f in rules.foreign_keys if f.table == table):
            if fk.source_nullable:
                broken["FK_NULL_RELATION", fk.name] = null_predicate(fk.columns)
            if "FK_ORPHAN_ROWS" in kinds and fk.parent in tables and set(fk.parent_columns) <= set(tables[fk.parent].columns):
                flag = f"__fk{len(broken)}"
                rows = lookup(rows, list(fk.columns), distinct_keys(tables[fk.parent], list(fk.parent_columns)), flag)
                broken["FK_ORPHAN_ROWS", fk.name] = f"NOT ({null_predicate(fk.columns)}) AND NOT {flag}"
        broken = {rule: p for rule, p in broken.items() if rule[0] in kinds}
        names = tables[table].columns
        if broken:
            hits = ", ".join(f"CASE WHEN {p} THEN {i} END" for i, p in enumerate(broken.values()))
            rows = rows.withColumn("__rule", F.expr(f"explode(array_compact(array({hits})))"))
            first = Window.partitionBy("__rule").orderBy(*sort_columns(tables[table]))
            parts.append(_placed(rows, first, limit, list(broken), table, names))
        keys = [k for k in rules.keys if k.table == table] if "DUPLICATE_KEY_VALUES" in kinds else []
        if keys:
            groups, own = key_groups(tables[table], keys)
            hit = F.array_compact(F.array(*[F.when(o, F.lit(i)) for i, o in enumerate(own)]))
            groups = groups.withColumn("__rule", F.explode(hit))
            order = sort_columns(groups.select(*[_tick(c) for c in groups.columns if c not in ("__set", "__rule", "duplicate_rows")]))
            most = Window.partitionBy("__rule").orderBy(F.desc("duplicate_rows"), *order)
            shown = [[*k.columns, "duplicate_rows"] for k in keys]
            parts.append(_placed(groups, most, limit, [("DUPLICATE_KEY_VALUES", k.name) for k in keys], table, shown))
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    empty = "type STRING, rule_name STRING, table_name STRING, place INT, names ARRAY<STRING>, sample ARRAY<STRING>"
    return balanced_union(parts) if parts else spark.createDataFrame([], empty)


def _placed(rows: DataFrame, order, limit: int, named: Sequence[tuple[str, str]], table: str, names: Sequence) -> DataFrame:
    """The first rows per rule under the rules' names; ``names`` are the columns shown, or a list of them per rule."""
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    per_rule = [names] * len(named) if names and isinstance(names[0], str) else list(names)

    def of(values: Sequence[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("__rule") + 1)

    shown = {tuple(n) for n in per_rule}
    sample = _texts_of(per_rule[0]) if len(shown) == 1 else of([_texts_of(n) for n in per_rule])
    return first.select(
        of([F.lit(kind) for kind, _ in named]).alias("type"), of([F.lit(rule) for _, rule in named]).alias("rule_name"),
        F.lit(table).alias("table_name"), "place", of([F.array(*[F.lit(c) for c in n]) for n in per_rule]).alias("names"),
        sample.alias("sample"),
    )


def _first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(*sort_columns(df)).limit(limit)


def repair_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """The child with the key columns of orphans set to NULL, and ``repaired`` to mark those rows.

    Unless all key columns accept NULL in the target, there is no automatic repair and the rows stay.
    """
    if set(fk.columns) - set(fk.target_nullable):
        return child.withColumn("repaired", F.lit(False))
    flagged = lookup(child, list(fk.columns), distinct_keys(parent, list(fk.parent_columns)), "__has_parent", hot_bytes)
    orphan = all_present(fk.columns) & ~F.col("__has_parent")
    flagged = flagged.withColumn("repaired", orphan)
    return flagged.select(
        *[
            F.when(~F.col("repaired"), F.col(f"`{c}`")).alias(c) if c in fk.columns else F.col(f"`{c}`")
            for c in child.columns
        ],
        "repaired",
    )
