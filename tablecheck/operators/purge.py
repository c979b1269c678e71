"""Everything that depends on a table along foreign keys, and purging or dropping it children first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions.unions import balanced_union
from tablecheck.model import Catalog, ForeignKey, TableRef
from tablecheck.operators import graph
from tablecheck.operators.skew import HOT_BYTES, distinct_keys, keyed_join, lookup
from tablecheck.sources.checkpoints import Scratch
from tablecheck.sources.store import TableStore
from tablecheck.sources.tables import resolve_name, table_counts

EDGE_DDL = "parent STRUCT<schema: STRING, name: STRING>, child STRUCT<schema: STRING, name: STRING>"


def fk_edges(catalog: Catalog) -> DataFrame:
    """Distinct parent-child pairs of tables; references of a table to itself are left out."""
    c = F.col
    parent_schema = F.coalesce(F.nullif(c("referenced_schema"), F.lit("")), F.lit(catalog.schema))
    return (
        catalog.constraints.filter("constraint_type = 'f'")
        .select(
            F.struct(parent_schema.alias("schema"), c("referenced_table").alias("name")).alias("parent"),
            F.struct(F.lit(catalog.schema).alias("schema"), c("table_name").alias("name")).alias("child"),
        )
        .filter(c("parent") != c("child"))
        .distinct()
    )


def raw_fk_edges(raw: Mapping[str, DataFrame], env: str | None = None) -> DataFrame:
    """Distinct parent-child pairs over all schemas, from the raw system tables of :mod:`tablecheck.sources.catalog`.

    A catalog holds the constraints of one schema; what lies in others may still depend on its tables. Without ``env`` the pairs
    of all servers come with the server's ``env``, since servers have tables of one name.
    """
    spaces = raw["namespace"].select("env", F.col("oid").alias("space"), F.col("nspname").alias("schema"))
    named = raw["class"].select("env", "oid", F.col("relnamespace").alias("space"), F.col("relname").alias("name"))
    keys = raw["constraint"].filter("contype = 'f'").select("env", F.col("conrelid").alias("child_id"), F.col("confrelid").alias("parent_id"))
    return _of_env(_resolved(keys, named, spaces), env)


def _resolved(keys: DataFrame, named: DataFrame, spaces: DataFrame) -> DataFrame:
    """``env, parent, child`` from keys between numbered tables in numbered schemas. Most keys may refer to one table."""
    refs = keyed_join(named, spaces, ["env", "space"], "inner").select("env", "oid", F.struct("schema", "name").alias("ref"))
    out = keys.distinct()
    for end in ("parent", "child"):
        out = keyed_join(out, refs.select("env", F.col("oid").alias(f"{end}_id"), F.col("ref").alias(end)), ["env", f"{end}_id"], "inner")
    return out.select("env", "parent", "child").filter(F.col("parent") != F.col("child")).distinct()


def _of_env(edges: DataFrame, env: str | None) -> DataFrame:
    return edges if env is None else edges.filter(F.col("env") == env).drop("env")


def key_usage_edges(usage: DataFrame, env: str | None = None) -> DataFrame:
    """As :func:`raw_fk_edges`, from a MySQL server's rows of key usage with their ``env``: a row per column of each key."""
    def ref(schema: str, name: str) -> Column:
        return F.struct(F.col(schema).alias("schema"), F.col(name).alias("name"))

    rows = usage.filter("referenced_table_name IS NOT NULL").select(
        "env", ref("referenced_table_schema", "referenced_table_name").alias("parent"), ref("table_schema", "table_name").alias("child")
    )
    return _of_env(rows.filter(F.col("parent") != F.col("child")).distinct(), env)


def object_edges(foreign_keys: DataFrame, tables: DataFrame, schemas: DataFrame, env: str | None = None) -> DataFrame:
    """As :func:`raw_fk_edges`, from a SQL Server's foreign keys, tables and schemas with their ``env``.

    There the *parent object* of a key is the table that has the key, so the child here.
    """
    keys = foreign_keys.select("env", F.col("parent_object_id").alias("child_id"), F.col("referenced_object_id").alias("parent_id"))
    named = tables.select("env", F.col("object_id").alias("oid"), F.col("schema_id").alias("space"), "name")
    return _of_env(_resolved(keys, named, schemas.select("env", F.col("schema_id").alias("space"), F.col("name").alias("schema"))), env)


def engine_edges(servers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """``engine, env, parent, child`` of servers of several kinds, each given by its raw tables:

    ``postgresql``: namespace, class, constraint; ``mysql``: key_column_usage; ``sqlserver``: foreign_keys, tables, schemas.
    """
    read = {
        "postgresql": raw_fk_edges,
        "mysql": lambda raw: key_usage_edges(raw["key_column_usage"]),
        "sqlserver": lambda raw: object_edges(raw["foreign_keys"], raw["tables"], raw["schemas"]),
    }
    parts = [read[engine](raw).select(F.lit(engine).alias("engine"), "env", "parent", "child") for engine, raw in servers.items()]
    return balanced_union(parts)


def rule_edges(spark: SparkSession, foreign_keys: Sequence[ForeignKey], schema: str = "public") -> DataFrame:
    rows = {((f.parent_schema or schema, f.parent), (f.table_schema or schema, f.table)) for f in foreign_keys}
    return spark.createDataFrame(sorted(r for r in rows if r[0] != r[1]), EDGE_DDL)


def closure(edges: DataFrame, root: TableRef | Column) -> DataFrame:
    """``table, depth`` for the root and all that depends on it; depth is the longest way from the root.

    Ordering by depth from the largest puts every child before its parents. Each round handles a
    whole frontier as joins; results of a round are written to the shared folder, so plans do not grow with depth.
    Raises when the foreign keys form a cycle.
    """
    spark = edges.sparkSession
    if "env" in edges.columns:
        raise ValueError("Choose the edges of one environment.")
    if isinstance(root, TableRef):
        root = F.struct(F.lit(root.schema).alias("schema"), F.lit(root.name).alias("name"))
    rounds = Rounds(spark)
    edges = rounds.keep(edges.distinct(), "edges")

    # Every round writes what it has found, never what was known before.
    frontier = rounds.add("reached", spark.range(1).select(root.alias("table")))
    while True:
        found = edges.join(frontier.toDF("parent"), "parent", "left_semi").select(F.col("child").alias("table")).distinct()
        frontier = rounds.add("reached", found.join(rounds.all("reached"), "table", "left_anti"))
        if frontier.isEmpty():
            break

    # A table is ranked in the round after the last of its parents.
    reached = rounds.all("reached")
    inside = rounds.keep(edges.join(reached.toDF("parent"), "parent", "left_semi"), "inside")
    parents = rounds.keep(inside.groupBy(F.col("child").alias("table")).agg(F.count("*").alias("open")), "parents")
    fresh = rounds.add("ranked", reached.join(parents, "table", "left_anti").select("table", F.lit(0).alias("depth")))
    depth = 0
    while not fresh.isEmpty():
        depth += 1
        closed = rounds.add("closed", inside.join(fresh.select(F.col("table").alias("parent")), "parent").select(F.col("child").alias("table")))
        touched = rounds.all("closed").join(closed.distinct(), "table", "left_semi").groupBy("table").agg(F.count("*").alias("n"))
        ready = touched.join(parents, "table").filter("n = open").select("table", F.lit(depth).alias("depth"))
        fresh = rounds.add("ranked", ready)
    ranked = rounds.all("ranked")
    waiting = reached.join(ranked, "table", "left_anti")
    if not waiting.isEmpty():
        among = inside.join(waiting.toDF("parent"), "parent", "left_semi").join(waiting.toDF("child"), "child", "left_semi")
        raise ValueError(f"The foreign keys form a cycle: {_cycle(rounds.keep(among, 'among'))}.")
    return ranked


class Rounds(Scratch):
    """Tables that grow by a part per round."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._parts: dict[str, list[DataFrame]] = {}

    def add(self, name: str, part: DataFrame) -> DataFrame:
        self._parts.setdefault(name, []).append(self.keep(part, name))
        return self._parts[name][-1]

    def all(self, name: str) -> DataFrame:
        """All parts so far, as one scan over their files."""
        parts = self._parts[name]
        return self.spark.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()]) if len(parts) > 1 else parts[0]


def _cycle(edges: DataFrame) -> str:
    """A cycle through the smallest table that lies on one, written as a path. :func:`graph.components` lists all of them."""
    knots = graph.components(edges)
    first = knots.select(F.min("component")).first()[0]
    own = knots.filter(F.col("component") == F.struct(F.lit(first[0]).alias("schema"), F.lit(first[1]).alias("name"))).select("table")
    among = edges.join(own.toDF("parent"), "parent", "left_semi").join(own.toDF("child"), "child", "left_semi")
    # One parent per table of one component, names only: from any of them, going to a parent must come round again.
    step = {TableRef(*r.child): TableRef(*r.parent) for r in among.groupBy("child").agg(F.min("parent").alias("parent")).collect()}
    path, here = [], min(step)
    while here not in path:
        path.append(here)
        here = step[here]
    path = path[path.index(here):][::-1]
    # The walk went from child to parent; the path is told from parent to child.
    start = path.index(min(path))
    path = path[start:] + path[:start]
    return " -> ".join(f"{t.schema}.{t.name}" for t in path + path[:1])


def deletion_order(closed: DataFrame) -> DataFrame:
    return closed.orderBy(F.desc("depth"), "table.schema", "table.name")


@dataclass(frozen=True)
class PurgePlan:
    """Tables to empty or drop, children first, with their row counts; made for one side.

    ``version`` is that of the store whose tables were counted. Carrying out the plan fails if the store has another by then.
    """

    side: str
    target: TableRef
    order: tuple[TableRef, ...]
    row_counts: Mapping[TableRef, int]
    version: int | None = None

    @property
    def total_rows(self) -> int:
        return sum(self.row_counts.values())

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.schema, t.name, self.row_counts[t]) for i, t in enumerate(self.order, 1)]
        return spark.createDataFrame(rows, "ord INT, schema STRING, name STRING, row_count BIGINT")


def by_ref(tables: Mapping[str | TableRef, DataFrame], schema: str = "public") -> dict[TableRef, DataFrame]:
    """Tables by schema and name. A plain name is one of ``schema``; ``schema.name`` is one of that schema."""
    return {_ref(t, schema): df for t, df in tables.items()}


def _ref(table: str | TableRef, schema: str) -> TableRef:
    if isinstance(table, TableRef):
        return table
    space, dot, name = table.partition(".")
    return TableRef(space, name) if dot else TableRef(schema, table)


def _name(ref: TableRef, schema: str) -> str:
    return ref.name if ref.schema == schema else f"{ref.schema}.{ref.name}"


def plan_rows(
    tables: Mapping[str | TableRef, DataFrame], edges: DataFrame, root: TableRef, schema: str = "public"
) -> DataFrame:
    """The plan as a frame, ``depth, schema, name, row_count``; counts of all tables are one job.

    Raises, naming them, when tables of the closure are not among ``tables``: a purge without them would leave orphans.
    """
    closed = closure(edges, root)
    known = by_ref(tables, schema)
    refs = sorted(TableRef(*r.table) for r in closed.select("table").collect())
    absent = [f"{r.schema}.{r.name}" for r in refs if r not in known]
    if absent:
        raise ValueError(f"These tables depend on {root.schema}.{root.name} but are not loaded: {', '.join(absent)}.")
    counts = table_counts({f"{r.schema}.{r.name}": known[r] for r in refs})
    whole = closed.select("depth", "table.schema", "table.name").withColumn("table_name", F.concat_ws(".", "schema", "name"))
    return whole.join(counts, "table_name").select("depth", "schema", "name", "row_count")


def purge_plan(
    tables: Mapping[str | TableRef, DataFrame], edges: DataFrame, root: str, side: str = "target", schema: str | None = None,
    catalog: Catalog | None = None, version: int | None = None,
) -> PurgePlan:
    """The plan for one table of ``schema``, by default the catalog's."""
    schema = schema or (catalog.schema if catalog is not None else "public")
    name = resolve_name(catalog, root, side) if catalog is not None else root
    ref = TableRef(schema, name)
    rows = plan_rows(tables, edges, ref, schema).orderBy(F.desc("depth"), "schema", "name").collect()
    refs = tuple(TableRef(r.schema, r.name) for r in rows)
    return PurgePlan(side, ref, refs, {TableRef(r.schema, r.name): r.row_count for r in rows}, version)


def store_plan(
    store: TableStore, edges: DataFrame, root: str, side: str = "target", schema: str | None = None, catalog: Catalog | None = None,
) -> PurgePlan:
    """The plan for one table of a store as it is now, which holds for this version only."""
    version = store.version()
    return purge_plan(store.read_all(version), edges, root, side, schema, catalog, version)


def doomed_rows(
    tables: Mapping[str | TableRef, DataFrame], foreign_keys: Sequence[ForeignKey], order: Sequence[str | TableRef],
    where: Column | None = None, hot_bytes: int = HOT_BYTES, schema: str = "public",
) -> dict[str, DataFrame]:
    """Every table of the closure with ``doomed``: whether a purge of the root takes the row.

    ``order`` lists the closure parents first. Without ``where`` all rows go. With it, the root loses
    the rows it selects and every child the rows that refer to a row that is lost; in a table that refers to itself, so do
    rows that refer to those, and so on. The lost keys of each table are
    written once to the shared folder when this is called, so a table's plan has one join per foreign key, at any depth.
    """
    known = by_ref(tables, schema)
    refs = [_ref(t, schema) for t in order]
    if where is None:
        return {_name(r, schema): known[r].withColumn("doomed", F.lit(True)) for r in refs}
    ends = [(TableRef(f.table_schema or schema, f.table), TableRef(f.parent_schema or schema, f.parent), f) for f in foreign_keys]
    inside = set(refs)
    scratch = Scratch(known[refs[0]].sparkSession)
    lost: dict[tuple[TableRef, tuple[str, ...]], DataFrame] = {}
    flagged: dict[str, DataFrame] = {}
    for ref in refs:
        df = known[ref]
        if not flagged:
            df = df.withColumn("doomed", F.coalesce(where, F.lit(False)))
        else:
            hits: list[str] = []
            for child, parent, fk in ends:
                if child == ref and (parent, fk.parent_columns) in lost:
                    hits.append(f"__lost{len(hits)}")
                    df = lookup(df, list(fk.columns), lost[parent, fk.parent_columns], hits[-1], hot_bytes)
            gone = reduce(lambda a, b: a | b, [F.col(h) for h in hits], F.lit(False))
            df = df.withColumn("doomed", gone).drop(*hits)
        own = [fk for child, parent, fk in ends if child == parent == ref]
        if own:
            df = _with_descendants(df, own, scratch, hot_bytes)
        flagged[_name(ref, schema)] = df
        for child, parent, fk in ends:
            if parent == ref and child in inside and (ref, fk.parent_columns) not in lost:
                keys = distinct_keys(df.filter("doomed"), list(fk.parent_columns))
                lost[ref, fk.parent_columns] = scratch.keep(keys, "lost")
    return flagged


def _with_descendants(df: DataFrame, own: Sequence[ForeignKey], scratch: Scratch, hot_bytes: int) -> DataFrame:
    """``doomed`` also for rows that refer, over any number of the table's rows, to one that is doomed.

    A fixpoint over keys alone: each round joins the keys lost in the round before with the rows that are left, and keeps
    what is lost anew. Loops end, since no key is lost twice; the number of rounds is the longest chain from a doomed row.
    """
    keys = [(list(fk.columns), list(fk.parent_columns)) for fk in own]
    needed = sorted({c for pair in keys for part in pair for c in part})
    narrow = df.select("doomed", *[f"`{c}`" for c in needed])
    rows = scratch.keep(narrow.filter("NOT doomed").drop("doomed").distinct(), "referring")
    lost = [scratch.keep(distinct_keys(narrow.filter("doomed"), parent), "lost") for _, parent in keys]
    fresh = list(lost)
    while not all(f.isEmpty() for f in fresh):
        hit = rows
        for i, ((child, _), part) in enumerate(zip(keys, fresh)):
            hit = lookup(hit, child, part, f"__hit{i}", hot_bytes)
        hit = scratch.keep(hit.filter(" OR ".join(f"__hit{i}" for i in range(len(keys)))).select(*[f"`{c}`" for c in needed]), "hit")
        fresh = [
            scratch.keep(distinct_keys(hit, parent).join(known, parent, "left_anti"), "fresh") for (_, parent), known in zip(keys, lost)
        ]
        lost = [scratch.keep(known.unionByName(part), "lost") for known, part in zip(lost, fresh)]
    for i, ((child, _), known) in enumerate(zip(keys, lost)):
        df = lookup(df, child, known, f"__own{i}", hot_bytes)
    doomed = reduce(lambda a, b: a | b, [F.col(f"__own{i}") for i in range(len(keys))], F.col("doomed"))
    return df.withColumn("doomed", doomed).drop(*[f"__own{i}" for i in range(len(keys))])


def purge_counts(flagged: Mapping[str, DataFrame]) -> DataFrame:
    """Rows lost and kept per table."""
    parts = [
        df.agg(
            F.count_if("doomed").alias("deleted_rows"), F.count_if(~F.col("doomed")).alias("kept_rows")
        ).select(F.lit(t).alias("table_name"), "deleted_rows", "kept_rows")
        for t, df in flagged.items()
    ]
    return balanced_union(parts)


def cascade_purge(
    store: TableStore, plan: PurgePlan, foreign_keys: Sequence[ForeignKey], where: Column | None = None,
    side: str = "target",
) -> dict[TableRef, int]:
    """Carry out a plan: all tables change together or none does. Returns the rows deleted per table.

    Works on the plan's version of the store, or the newest if the plan names none, and fails, changing nothing, if another
    version is published by then.
    """
    _check_side(plan, side)
    version = store.version() if plan.version is None else plan.version
    tables, schema = store.read_all(version), plan.target.schema
    flagged = doomed_rows(tables, foreign_keys, list(reversed(plan.order)), where, schema=schema)
    names = {t: _name(t, schema) for t in plan.order}
    before = {r.table_name: r.row_count for r in table_counts({n: tables[n] for n in names.values()}).collect()}
    kept = store.publish({t: df.filter("NOT doomed").drop("doomed") for t, df in flagged.items()}, after=version)
    return {t: before[n] - kept[n] for t, n in names.items()}


def cascade_drop(store: TableStore, plan: PurgePlan, side: str = "target") -> list[TableRef]:
    """Remove the plan's tables from the store in one step; their order is children first. The plan must name its version, which
    must still be the newest."""
    _check_side(plan, side)
    if plan.version is None:
        raise ValueError("The plan does not say which version of the store it was made for.")
    store.publish({}, drop=[_name(t, plan.target.schema) for t in plan.order], after=plan.version)
    return list(plan.order)


def _check_side(plan: PurgePlan, side: str) -> None:
    if plan.side != side:
        raise ValueError("The plan was made for another side.")
