"""Queries on table data: integrity, comparison, alignment, replacement and purge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck import testkit
from tablecheck.model import ForeignKey, Key, RuleSet, Side, TableRef
from tablecheck.operators import align, diff, digests, integrity, partials, purge, structure
from tablecheck.plans import report
from tablecheck.plans.audit import run_audit
from tablecheck.sources.catalog import catalog_from_dataframes
from tablecheck.sources.checkpoints import Scratch
from tablecheck.sources.store import TableStore
from tablecheck.sources.tables import load_side, scan, split_predicates
from tablecheck.sources.tables import source_status as status_of
from tablecheck.sources.tables import table_counts as counts_of

QUERIES = {}
ORACLES = {}


def register(name: str, oracle_sql: str):
    def add(query):
        QUERIES[name] = query
        ORACLES[name] = oracle_sql
        return query

    return add


# The damaged sides again, in SQL.
ORDERS_T = (
    "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, "
    "o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 103 = 0)"
)
ORDERS_P = "(SELECT * FROM orders WHERE o_orderkey % 97 <> 0)"


def orders_n(base: str = "orders") -> str:
    return (
        "(SELECT o_orderkey, CASE WHEN o_orderkey % 89 <> 0 THEN o_custkey END AS o_custkey, "
        "CASE WHEN o_orderkey % 83 = 0 THEN '  ' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, "
        f"CASE WHEN o_orderkey % 79 <> 0 THEN o_orderpriority END AS o_orderpriority FROM {base} x)"
    )


TARGET = {**{t: t for t in testkit.TABLES}, "orders": orders_n(ORDERS_P)}


# --- integrity: expected findings, spelled out in SQL ---------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _finding(stage, kind, impact, rule, table, columns, reason, before, after, count_sql, review, fix="") -> str:
    rank = ["CRITICAL", "HIGH", "MEDIUM", "LOW"].index(impact) + 1
    return (
        f"SELECT CAST({stage} AS INT) AS stage, '{kind}' AS type, '{impact}' AS impact, CAST({rank} AS INT) AS impact_rank, "
        f"'{rule}' AS rule_name, '{table}' AS table_name, '{','.join(columns)}' AS columns, {_quoted(reason)} AS impact_reason, "
        f"{_quoted(before)} || n || {_quoted(after)} AS description, n AS count, {_quoted(review)} AS review_sql, {_quoted(fix)} AS fix_sql "
        f"FROM (SELECT CAST({count_sql} AS BIGINT) AS n) c WHERE n > 0"
    )


def expected_findings(kinds: tuple[str, ...] = integrity.STAGES) -> str:
    rules = testkit.rules()
    out = []
    for r in rules.required:
        at = f'"public"."{r.table}"'
        if "REQUIRED_NULL_VALUES" in kinds:
            out.append(_finding(
                1, "REQUIRED_NULL_VALUES", "CRITICAL", r.column, r.table, [r.column],
                "These rows break NOT NULL and whatever depends on the column.",
                f"Required column '{r.table}.{r.column}' is NULL in ", " row(s) of the target.",
                f"(SELECT count(*) FROM {TARGET[r.table]} t WHERE {r.column} IS NULL)",
                f'SELECT * FROM {at} WHERE "{r.column}" IS NULL LIMIT 50;',
            ))
        if r.text and "REQUIRED_EMPTY_TEXT" in kinds:
            out.append(_finding(
                5, "REQUIRED_EMPTY_TEXT", "MEDIUM", r.column, r.table, [r.column],
                "Not NULL, yet blank text in a required column usually means incomplete data.",
                f"Required text column '{r.table}.{r.column}' is blank in ", " row(s).",
                f"(SELECT count(*) FROM {TARGET[r.table]} t WHERE trim({r.column}, ' ') = '')",
                f"SELECT * FROM {at} WHERE btrim(\"{r.column}\") = '' LIMIT 50;",
            ))
    for f in rules.foreign_keys:
        (child,), (parent,) = f.columns, f.parent_columns
        at = f'"public"."{f.table}"'
        if f.source_nullable and "FK_NULL_RELATION" in kinds:
            out.append(_finding(
                2, "FK_NULL_RELATION", "HIGH", f.name, f.table, f.columns,
                "The schema allows it, but rows without the relation may lack their parent.",
                f"Relation '{f.name}' of '{f.table}' has ", " row(s) with NULL in its columns.",
                f"(SELECT count(*) FROM {TARGET[f.table]} t WHERE {child} IS NULL)",
                f'SELECT * FROM {at} WHERE "{child}" IS NULL LIMIT 50;',
            ))
        if "FK_ORPHAN_ROWS" in kinds:
            gone = f'NOT EXISTS (SELECT 1 FROM "public"."{f.parent}" p WHERE p."{parent}" = c."{child}")'
            fix = (
                f'UPDATE {at} c\nSET "{child}" = NULL\nWHERE c."{child}" IS NOT NULL\n  AND {gone};' if f.target_nullable else
                "-- No automatic fix: not every column of the foreign key accepts NULL. Insert the missing parent or point "
                "the rows at an existing one."
            )
            out.append(_finding(
                3, "FK_ORPHAN_ROWS", "CRITICAL", f.name, f.table, f.columns, "These rows break the foreign key.",
                f"Relation '{f.name}' has ", f" row(s) in '{f.table}' without a parent in '{f.parent}'.",
                f"(SELECT count(*) FROM {TARGET[f.table]} c WHERE {child} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {TARGET[f.parent]} p WHERE p.{parent} = c.{child}))",
                f'SELECT c.* FROM {at} c WHERE c."{child}" IS NOT NULL AND {gone} LIMIT 50;', fix,
            ))
    if "DUPLICATE_KEY_VALUES" in kinds:
        for k in rules.keys:
            columns = ", ".join(k.columns)
            quoted = ", ".join(f'"{c}"' for c in k.columns)
            present = " AND ".join(f'"{c}" IS NOT NULL' for c in k.columns)
            where = f"WHERE {present} " if k.kind == "u" else ""
            out.append(_finding(
                4, "DUPLICATE_KEY_VALUES", "CRITICAL", k.name, k.table, k.columns,
                "Duplicates break the key and may stand for one entity twice.",
                f"Key '{k.name}' of '{k.table}' has ", " surplus duplicate row(s).",
                f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {TARGET[k.table]} t {where}GROUP BY {columns} HAVING count(*) > 1) g)",
                f'SELECT {quoted}, COUNT(*) AS duplicate_rows FROM "public"."{k.table}" {where}GROUP BY {quoted} '
                "HAVING COUNT(*) > 1 ORDER BY duplicate_rows DESC LIMIT 50;",
            ))
    return "\nUNION ALL\n".join(out)


def findings(spark: SparkSession, folder: str, kinds: tuple[str, ...] = integrity.STAGES, bitmaps: bool = False) -> DataFrame:
    tables = testkit.target_tables(testkit.load(spark, folder))
    found = integrity.check(tables, testkit.rules(), kinds=kinds, bitmaps=bitmaps)
    return found.withColumn("columns", F.array_join("columns", ","))


for _name, _kinds in {
    "integrity_run": integrity.STAGES,
    "required_nulls": ("REQUIRED_NULL_VALUES",),
    "required_empty_text": ("REQUIRED_EMPTY_TEXT",),
    "fk_null_relation": ("FK_NULL_RELATION",),
    "fk_orphans_all": ("FK_ORPHAN_ROWS",),
}.items():
    QUERIES[_name] = lambda spark, folder, kinds=_kinds, name=_name: findings(spark, folder, kinds, name == "fk_orphans_all")
    ORACLES[_name] = expected_findings(_kinds)

@register("integrity_incremental", expected_findings())
def integrity_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that arrive in two parts: the second run reads the second part alone and finds what a full run finds."""
    root = Scratch(spark).root
    tables = testkit.target_tables(testkit.load(spark, folder))
    paths = {t: f"{root}/{t}" for t in tables}
    for part in range(2):
        for t, df in tables.items():
            df.filter(F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(2)) == part).write.mode("append").parquet(paths[t])
        kept = partials.PartialFindings(spark, f"{root}/partials", paths, testkit.rules())
        kept.refresh()
    return kept.findings().withColumn("columns", F.array_join("columns", ","))


# Unique columns with NULLs, which count as no value, and a unique pair of which either may be NULL.
UNIQUE_TARGET = {
    **TARGET,
    "documents": "(SELECT * REPLACE (CASE WHEN doc_id % 5 <> 0 THEN text END AS text) FROM documents)",
    "part": "(SELECT * REPLACE (CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS p_name) FROM part)",
}
_PAIR = Key("orders_custkey_priority_key", "orders", ("o_custkey", "o_orderpriority"), "u")
_PRIMARY = tuple(k for k in testkit.rules().keys if k.kind == "p")
_UNIQUE = (*(k for k in testkit.rules().keys if k.kind == "u"), _PAIR)


def _duplicates_sql(keys: tuple[Key, ...], target: dict[str, str]) -> str:
    def where(k: Key) -> str:
        return "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in k.columns) if k.kind == "u" else ""

    return "\nUNION ALL\n".join(
        f"SELECT '{k.name}' AS rule_name, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS count FROM "
        f"(SELECT count(*) AS n FROM {target[k.table]} t {where(k)} GROUP BY {', '.join(k.columns)} HAVING count(*) > 1) g"
        for k in keys
    )


def unique_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = testkit.target_tables(testkit.load(spark, folder))
    for table, key, by, n in (("documents", "text", "doc_id", 5), ("part", "p_name", "p_partkey", 7)):
        tables[table] = tables[table].withColumn(key, F.when(F.col(by) % n != 0, F.col(key)))
    return tables


@register("duplicate_keys", _duplicates_sql(_PRIMARY, TARGET))
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    tables = testkit.target_tables(testkit.load(spark, folder))
    return integrity.check(tables, RuleSet(keys=_PRIMARY), include_zero=True).select("rule_name", "count")


@register("duplicate_unique", _duplicates_sql(_UNIQUE, UNIQUE_TARGET))
def duplicate_unique(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.check(unique_tables(spark, folder), RuleSet(keys=_UNIQUE), include_zero=True).select("rule_name", "count")


@register("duplicate_all_keys", _duplicates_sql((*_PRIMARY, *_UNIQUE), UNIQUE_TARGET))
def duplicate_all_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Primary and unique keys together: one scan of each table, however many keys it has."""
    rules = RuleSet(keys=(*_PRIMARY, *_UNIQUE))
    return integrity.check(unique_tables(spark, folder), rules, include_zero=True).select("rule_name", "count")


def _samples_sql() -> str:
    """The first rows of every rule, a query for each."""
    rules, out = testkit.rules(), []

    def rows(kind: str, rule: str, table: str, where: str) -> None:
        shown = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in COLUMNS[table]) + ")"
        order = ", ".join(f"{c} NULLS FIRST" for c in COLUMNS[table])
        out.append(
            f"SELECT '{kind}' AS type, '{rule}' AS rule_name, '{table}' AS table_name, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place, "
            f"'{','.join(COLUMNS[table])}' AS names, {shown} AS sample FROM {TARGET[table]} t WHERE {where} QUALIFY place <= 50"
        )

    for r in rules.required:
        rows("REQUIRED_NULL_VALUES", r.column, r.table, f"{r.column} IS NULL")
        if r.text:
            rows("REQUIRED_EMPTY_TEXT", r.column, r.table, f"trim({r.column}, ' ') = ''")
    for f in rules.foreign_keys:
        child, parent = f.columns[0], f.parent_columns[0]
        if f.source_nullable:
            rows("FK_NULL_RELATION", f.name, f.table, f"{child} IS NULL")
        rows("FK_ORPHAN_ROWS", f.name, f.table, f"{child} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {TARGET[f.parent]} p WHERE p.{parent} = t.{child})")
    for k in rules.keys:
        where = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in k.columns) if k.kind == "u" else ""
        key = ", ".join(k.columns)
        order = ", ".join(f"{c} NULLS FIRST" for c in sorted(k.columns))
        shown = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in k.columns)
        out.append(
            f"SELECT 'DUPLICATE_KEY_VALUES' AS type, '{k.name}' AS rule_name, '{k.table}' AS table_name, "
            f"CAST(row_number() OVER (ORDER BY n DESC, {order}) AS INT) AS place, '{','.join(k.columns)},duplicate_rows' AS names, "
            f"concat_ws('|', {shown}, n) AS sample FROM (SELECT {key}, count(*) AS n FROM {TARGET[k.table]} t {where} GROUP BY {key} HAVING n > 1) g "
            "QUALIFY place <= 50"
        )
    return "\nUNION ALL\n".join(out)


COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"), "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"), "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


@register("finding_samples", _samples_sql())
def finding_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of every broken rule."""
    found = integrity.samples(testkit.target_tables(testkit.load(spark, folder)), testkit.rules())
    shown = F.array_join("sample", "|", "-").alias("sample")
    return found.select("type", "rule_name", "table_name", "place", F.array_join("names", ",").alias("names"), shown)


LINE_ORDERS = ForeignKey("lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",), (), ("l_orderkey",))


@register(
    "fk_orphans",
    f"""SELECT l_orderkey, count(*) AS rows_per_key FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM {ORDERS_P} o WHERE o.o_orderkey = l_orderkey) GROUP BY l_orderkey""",
)
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Orphaned keys with the rows they hold."""
    t = testkit.load(spark, folder, "lineitem", "orders")
    return integrity.parent_lookup(t["lineitem"], LINE_ORDERS, testkit.orders_parents(t["orders"]))


@register(
    "fk_audit_relation",
    f"""SELECT 'FK_NULL_RELATION' AS type, 'LOW' AS impact, 'events_customer' AS rule_name, count(*) AS count FROM events_n WHERE user_id IS NULL
UNION ALL SELECT 'FK_ORPHAN_ROWS', 'LOW', 'events_customer', count(*) FROM events_n e WHERE user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'FK_NULL_RELATION', 'HIGH', 'orders_customer', count(*) FROM {orders_n()} o WHERE o_custkey IS NULL
UNION ALL SELECT 'FK_ORPHAN_ROWS', 'CRITICAL', 'orders_customer', count(*) FROM {orders_n()} o WHERE o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'BUILDING')""".replace(
        "events_n", "(SELECT CASE WHEN event_type <> 'click' THEN user_id END AS user_id FROM events)"
    ),
)
def fk_audit_relation(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one segment are lost; the events' relation to customers counts as an audit relation."""
    t = testkit.load(spark, folder, "customer", "orders", "events")
    tables = {
        "customer": t["customer"].filter("c_mktsegment <> 'BUILDING'"),
        "orders": testkit.orders_nulls(t["orders"]),
        "events": t["events"].withColumn("user_id", F.when(F.col("event_type") != "click", F.col("user_id"))),
    }
    kinds = ("FK_NULL_RELATION", "FK_ORPHAN_ROWS")
    found = integrity.check(tables, testkit.rules(), audit=("user_id",), include_zero=True, kinds=kinds)
    return found.select("type", "impact", "rule_name", "count")


_ORDER_TEXT = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority"


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f.name: F.col(f.name).cast("string") for f in df.schema.fields if "timestamp" in f.dataType.simpleString()}
    )


@register(
    "review_nulls",
    f"SELECT {_ORDER_TEXT} FROM {orders_n()} t WHERE o_custkey IS NULL ORDER BY o_orderkey, o_custkey NULLS FIRST, o_orderstatus LIMIT 50",
)
def review_nulls(spark: SparkSession, folder: str) -> DataFrame:
    orders = testkit.orders_nulls(testkit.load(spark, folder, "orders")["orders"])
    return _dates_as_text(integrity.review_nulls(orders, ["o_custkey"]))


@register(
    "review_blanks",
    f"SELECT {_ORDER_TEXT} FROM {orders_n()} t WHERE trim(o_orderstatus, ' ') = '' ORDER BY o_orderkey LIMIT 50",
)
def review_blanks(spark: SparkSession, folder: str) -> DataFrame:
    orders = testkit.orders_nulls(testkit.load(spark, folder, "orders")["orders"])
    return _dates_as_text(integrity.review_blanks(orders, "o_orderstatus"))


@register(
    "review_orphans",
    f"""SELECT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM (SELECT * FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM {ORDERS_P} o WHERE o.o_orderkey = l_orderkey) ORDER BY ALL LIMIT 50) x""",
)
def review_orphans(spark: SparkSession, folder: str) -> DataFrame:
    t = testkit.load(spark, folder, "lineitem", "orders")
    rows = integrity.review_orphans(t["lineitem"], testkit.orders_parents(t["orders"]), LINE_ORDERS)
    return _dates_as_text(rows)


@register(
    "review_duplicates",
    """SELECT l_orderkey, l_linenumber, count(*) AS duplicate_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
ORDER BY duplicate_rows DESC, l_orderkey, l_linenumber LIMIT 50""",
)
def review_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    lines = testkit.load(spark, folder, "lineitem")["lineitem"]
    return integrity.review_duplicates(lines, Key("lineitem_pkey", "lineitem", ("l_orderkey", "l_linenumber")))


@register(
    "repair_orphans",
    f"""SELECT CASE WHEN o.o_orderkey IS NOT NULL THEN l_orderkey END AS l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate,
  o.o_orderkey IS NULL AS repaired FROM lineitem LEFT JOIN {ORDERS_P} o ON o.o_orderkey = l_orderkey""",
)
def repair_orphans(spark: SparkSession, folder: str) -> DataFrame:
    t = testkit.load(spark, folder, "lineitem", "orders")
    fixed = integrity.repair_orphans(t["lineitem"], testkit.orders_parents(t["orders"]), LINE_ORDERS)
    return fixed.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@register(
    "finding_report",
    f"""SELECT number, number || '. [' || impact || '] ' || type || chr(10) || '   ' || description || chr(10) || '   Affected rows: ' || count
  || chr(10) || '   Reason: ' || impact_reason || chr(10) || '   Review query:' || chr(10) || '   ' || review_sql
  || CASE WHEN fix_sql <> '' THEN chr(10) || '   Proposed repair:' || chr(10) || '   ' || fix_sql ELSE '' END || chr(10) AS value
FROM (SELECT *, row_number() OVER (ORDER BY impact_rank, stage, table_name, rule_name) AS number FROM ({expected_findings()}) f) x""",
)
def finding_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = report.numbered(findings(spark, folder), report.FINDING_ORDER)
    return rows.select("number", report.finding_text(F.col("number")).alias("value"))


@register(
    "orphan_fixes",
    f"""SELECT number, '-- ' || number || '. ' || type || chr(10) || '-- Impact: ' || impact || chr(10) || '-- Affected rows: ' || count
  || chr(10) || '-- ' || description || chr(10) || CASE WHEN fix_sql = '' THEN '-- No automatic fix.' ELSE fix_sql END || chr(10) AS value
FROM (SELECT *, row_number() OVER (ORDER BY impact_rank, stage, table_name, rule_name) AS number
  FROM ({expected_findings(("FK_ORPHAN_ROWS",))}) f) x""",
)
def orphan_fixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = report.numbered(findings(spark, folder, ("FK_ORPHAN_ROWS",)), report.FINDING_ORDER)
    return rows.select("number", report.fix_block(F.col("number")).alias("value"))


# --- comparison of data -------------------------------------------------------------------------------


def counts_sql(source: str, target: str, columns: str = "*") -> str:
    s, t = f"SELECT {columns} FROM {source} s", f"SELECT {columns} FROM {target} t"
    return f"""SELECT source_row_count, target_row_count, only_source_count, only_target_count, TRUE AS data_compared,
  only_source_count = 0 AND only_target_count = 0 AS data_equal FROM (SELECT (SELECT count(*) FROM {source} s) AS source_row_count,
  (SELECT count(*) FROM {target} t) AS target_row_count, (SELECT count(*) FROM ({s} EXCEPT ALL {t}) x) AS only_source_count,
  (SELECT count(*) FROM ({t} EXCEPT ALL {s}) x) AS only_target_count) c"""


@register("projected_scan", "SELECT o_totalprice, o_orderkey, o_custkey FROM orders")
def projected_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Three columns of a table in an order of their own; the reader fetches no others."""
    return scan(testkit.load(spark, folder, "orders")["orders"], ["o_totalprice", "o_orderkey", "o_custkey"])


@register(
    "scan_splits",
    "SELECT count(*) AS row_count, CAST(1 AS BIGINT) AS least_met, CAST(1 AS BIGINT) AS most_met, TRUE AS balanced FROM orders",
)
def scan_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions that split a table by a crowded key: every row meets one, and none has more than twice the mean."""
    crowded = F.when(F.col("o_orderkey") % 3 == 0, 7).when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") * F.col("o_custkey"))
    rows = testkit.load(spark, folder, "orders")["orders"].select(crowded.alias("k"), "o_orderkey")
    conditions = split_predicates(rows, ["k", "o_orderkey"], 16, "mysql")
    met = F.expr("+".join(f"CAST(coalesce({c}, false) AS BIGINT)" for c in conditions))
    sizes = F.greatest(*[F.expr(f"count_if({c})") for c in conditions])
    return rows.agg(
        F.count("*").alias("row_count"), F.min(met).alias("least_met"), F.max(met).alias("most_met"),
        (sizes * len(conditions) <= 2 * F.count("*")).alias("balanced"),
    )


def orders_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = testkit.load(spark, folder, "orders")["orders"]
    return orders, testkit.orders_target(orders)


@register("data_diff_counts", counts_sql("orders", ORDERS_T))
def data_diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    return diff.diff_counts(diff.bag_counts(*orders_pair(spark, folder)))


@register("data_diff_tree", counts_sql("orders", ORDERS_T))
def data_diff_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Two stored versions compared by their trees of digests."""
    root = Scratch(spark).root
    versions = [digests.DigestTree.write(df, f"{root}/v{n}", by=("o_orderkey",)) for n, df in enumerate(orders_pair(spark, folder))]
    return versions[0].compare(versions[1])


@register("data_diff_reverse", counts_sql(ORDERS_T, "orders"))
def data_diff_reverse(spark: SparkSession, folder: str) -> DataFrame:
    return diff.diff_counts(diff.bag_counts(*orders_pair(spark, folder)[::-1]))


@register(
    "data_diff_rows",
    f"""SELECT {_ORDER_TEXT}, CAST(sum(s) AS BIGINT) AS only_source, CAST(sum(t) AS BIGINT) AS only_target FROM (
SELECT *, 1 AS s, 0 AS t FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM {ORDERS_T} a) x UNION ALL
SELECT *, 0, 1 FROM (SELECT * FROM {ORDERS_T} b EXCEPT ALL SELECT * FROM orders) y) z GROUP BY ALL""",
)
def data_diff_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _dates_as_text(diff.excess_rows(diff.bag_counts(*orders_pair(spark, folder))))


@register(
    "data_diff_samples",
    f"""SELECT 'source' AS side, {_ORDER_TEXT} FROM (SELECT * FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM {ORDERS_T} a) x ORDER BY ALL LIMIT 20) s
UNION ALL SELECT 'target', {_ORDER_TEXT} FROM (SELECT * FROM (SELECT * FROM {ORDERS_T} b EXCEPT ALL SELECT * FROM orders) y ORDER BY ALL LIMIT 20) t""",
)
def data_diff_samples(spark: SparkSession, folder: str) -> DataFrame:
    excess = diff.excess_rows(diff.bag_counts(*orders_pair(spark, folder)))
    parts = [diff.diff_samples(excess, side).select(F.lit(side).alias("side"), "*") for side in ("source", "target")]
    return _dates_as_text(parts[0].unionByName(parts[1]))


_GATE = "Data was not compared because the columns of source and target differ."


@register(
    "data_diff_gate",
    f"""SELECT (SELECT count(*) FROM lineitem) AS source_row_count, (SELECT count(*) FROM lineitem) AS target_row_count,
  CAST(0 AS BIGINT) AS only_source_count, CAST(0 AS BIGINT) AS only_target_count, FALSE AS data_compared, FALSE AS data_equal,
  '{_GATE}' AS data_skip_reason""",
)
def data_diff_gate(spark: SparkSession, folder: str) -> DataFrame:
    lines = testkit.load(spark, folder, "lineitem")["lineitem"]
    return diff.compare_data(lines, lines.withColumnRenamed("l_tax", "L_Tax"))


@register(
    "data_diff_types",
    f"""SELECT count(*) AS source_row_count, count(*) AS target_row_count, count(o_custkey) AS only_source_count,
  count(o_custkey) AS only_target_count, TRUE AS data_compared, count(o_custkey) = 0 AS data_equal FROM {orders_n()} x""",
)
def data_diff_types(spark: SparkSession, folder: str) -> DataFrame:
    """The same values as text and as numbers never match, NULLs do; whole numbers match their doubles."""
    orders = testkit.orders_nulls(testkit.load(spark, folder, "orders")["orders"])
    source = orders.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    target = orders.withColumn("o_orderkey", F.col("o_orderkey").cast("double"))
    return diff.diff_counts(diff.bag_counts(source, target))


@register(
    "data_diff_decimals",
    """SELECT count(*) AS source_row_count, count(*) AS target_row_count, count(*) FILTER (WHERE o_totalprice <> floor(o_totalprice)) AS only_source_count,
  count(*) FILTER (WHERE o_totalprice <> floor(o_totalprice)) AS only_target_count, TRUE AS data_compared,
  count(*) FILTER (WHERE o_totalprice <> floor(o_totalprice)) = 0 AS data_equal FROM orders""",
)
def data_diff_decimals(spark: SparkSession, folder: str) -> DataFrame:
    """Prices against their whole parts, in two decimal types that no third one holds both of."""
    orders = testkit.load(spark, folder, "orders")["orders"]
    source = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(38,18)"))
    target = orders.withColumn("o_totalprice", F.floor("o_totalprice").cast("decimal(38,0)"))
    return diff.diff_counts(diff.bag_counts(source, target))


@register(
    "data_diff_moved_nulls",
    """SELECT count(*) AS source_row_count, count(*) AS target_row_count, count(*) FILTER (WHERE (doc_id % 3 = 0) AND (doc_id % 2 = 0)) AS only_source_count,
  count(*) FILTER (WHERE (doc_id % 3 = 0) AND (doc_id % 2 = 0)) AS only_target_count, TRUE AS data_compared,
  count(*) FILTER (WHERE (doc_id % 3 = 0) AND (doc_id % 2 = 0)) = 0 AS data_equal, '' AS data_skip_reason FROM documents""",
)
def data_diff_moved_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """By buckets: in every third document a length moves to another column, which shows where only one had it."""
    docs = testkit.load(spark, folder, "documents")["documents"]
    one, other = F.when(F.col("doc_id") % 2 == 1, F.col("n_chars")), F.col("n_chars")
    source = docs.withColumns({"a": one, "b": other})
    move = F.col("doc_id") % 3 == 0
    target = docs.withColumns({"a": F.when(move, other).otherwise(one), "b": F.when(move, one).otherwise(other)})
    return diff.compare_data(source, target, bucket_rows=64)


_EMBEDDINGS_T = "(SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN label + 1 ELSE label END AS label FROM embeddings)"


@register("data_diff_arrays", counts_sql("embeddings", _EMBEDDINGS_T))
def data_diff_arrays(spark: SparkSession, folder: str) -> DataFrame:
    vectors = testkit.load(spark, folder, "embeddings")["embeddings"]
    changed = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return diff.diff_counts(diff.bag_counts(vectors, changed))


_DOCUMENTS_T = (
    "(SELECT doc_id, CASE WHEN doc_id % 91 = 0 THEN text || ' ' ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 57 <> 0)"
)


@register("data_diff_texts", counts_sql("documents", _DOCUMENTS_T))
def data_diff_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = testkit.load(spark, folder, "documents")["documents"]
    changed = docs.filter("doc_id % 57 <> 0").withColumn(
        "text", F.when(F.col("doc_id") % 91 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    )
    return diff.diff_counts(diff.bag_counts(docs, changed))


LINES_T = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "CASE WHEN l_orderkey % 991 = 0 THEN l_discount + 1 ELSE l_discount END AS l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate "
    "FROM lineitem WHERE l_orderkey % 997 <> 0)"
)


def lines_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = testkit.load(spark, folder, "lineitem")["lineitem"]
    changed = lines.filter("l_orderkey % 997 <> 0").withColumn(
        "l_discount", F.when(F.col("l_orderkey") % 991 == 0, F.col("l_discount") + 1).otherwise(F.col("l_discount"))
    )
    return lines, changed


@register("data_diff_lineitem", counts_sql("lineitem", LINES_T))
def data_diff_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return diff.diff_counts(diff.bag_counts(*lines_pair(spark, folder)))


@register(
    "data_diff_buckets",
    f"SELECT only_source_count, only_target_count, source_row_count, target_row_count FROM ({counts_sql('lineitem', LINES_T)}) c",
)
def data_diff_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same comparison with equal hash buckets left out first."""
    summary = diff.compare_data(*lines_pair(spark, folder), bucket_rows=150)
    return summary.select("only_source_count", "only_target_count", "source_row_count", "target_row_count")


_SIDES = {**{t: t for t in testkit.TABLES}, "orders": ORDERS_T, "documents": _DOCUMENTS_T, "embeddings": _EMBEDDINGS_T}
_GATED = ("lineitem",)


def _rollup_sql() -> str:
    parts = []
    for t in testkit.TABLES:
        if t in _GATED:
            counts = f"SELECT (SELECT count(*) FROM {t}) AS source_row_count, (SELECT count(*) FROM {t}) AS target_row_count, 0 AS only_source_count, 0 AS only_target_count, FALSE AS data_compared, FALSE AS data_equal"
        else:
            counts = counts_sql(t, _SIDES[t])
        parts.append(
            f"SELECT '{t}' AS table_name, source_row_count, target_row_count, CAST(only_source_count AS BIGINT) AS only_source_count, "
            f"CAST(only_target_count AS BIGINT) AS only_target_count, '{'DIFFERENT' if t in _GATED else 'EQUAL'}' AS structure_status, "
            "CASE WHEN NOT data_compared THEN 'NOT COMPARED' WHEN data_equal THEN 'EQUAL' ELSE 'DIFFERENT' END AS data_status, "
            f"CASE WHEN data_compared AND data_equal THEN 'EQUAL' ELSE 'DIFFERENT' END AS overall_status FROM ({counts}) x"
        )
    return "\nUNION ALL\n".join(parts)


@register("status_rollup", _rollup_sql())
def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Every table against its damaged copy, rolled up to one status each."""
    t = testkit.load(spark, folder)
    other = dict(t)
    other["orders"] = testkit.orders_target(t["orders"])
    other["lineitem"] = t["lineitem"].drop("l_tax")
    other["embeddings"] = t["embeddings"].withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))
    )
    other["documents"] = t["documents"].filter("doc_id % 57 <> 0").withColumn(
        "text", F.when(F.col("doc_id") % 91 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    )
    rules = testkit.rules()
    sides = [catalog_from_dataframes(spark, x, rules) for x in (t, other)]
    # The rules name a column that the other side lacks; its structure is what the tables themselves have.
    found = structure.structure_diff(*sides).groupBy(F.col("object_table").alias("table_name")).agg(F.count("*").alias("n"))
    summaries = [diff.compare_data(t[name], other[name]).withColumn("table_name", F.lit(name)) for name in sorted(t)]
    whole = reduce(DataFrame.unionByName, summaries).join(found, "table_name", "left")
    return report.status(whole, F.coalesce("n", F.lit(0))).select(
        "table_name", "source_row_count", "target_row_count", "only_source_count", "only_target_count",
        "structure_status", "data_status", "overall_status",
    )


def _compared_orders(spark: SparkSession, folder: str) -> diff.TableComparison:
    t = testkit.load(spark, folder, "orders", "customer")
    rules = testkit.rules().for_tables(t)
    other = {**t, "orders": testkit.orders_target(t["orders"])}
    keys = tuple(k for k in rules.keys if k.table != "orders")
    source = Side("source", t, catalog_from_dataframes(spark, t, rules))
    target = Side("target", other, catalog_from_dataframes(spark, other, RuleSet(rules.required, keys, rules.foreign_keys)))
    return diff.compare_table(source, target, "ORDERS")


@register(
    "compare_table",
    f"""SELECT 'orders' AS table_name, source_row_count, target_row_count, only_source_count, only_target_count,
  'DIFFERENT' AS structure_status, CASE WHEN data_equal THEN 'EQUAL' ELSE 'DIFFERENT' END AS data_status, 'DIFFERENT' AS overall_status,
  CAST(1 AS BIGINT) AS structure_differences FROM ({counts_sql('orders', ORDERS_T)}) x""",
)
def compare_table(spark: SparkSession, folder: str) -> DataFrame:
    """One table, asked for in capitals, whose key the target does not declare."""
    result = _compared_orders(spark, folder)
    n = result.structure.count()
    return report.status(result.summary, n).select(
        "table_name", "source_row_count", "target_row_count", "only_source_count", "only_target_count", "structure_status",
        "data_status", "overall_status", F.lit(n).cast("bigint").alias("structure_differences"),
    )


# --- loading --------------------------------------------------------------------------------------------


@register(
    "table_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in testkit.TABLES),
)
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts_of(testkit.load(spark, folder))


@register(
    "source_status",
    " UNION ALL ".join(
        f"SELECT 'source' AS side, '{t}' AS table_name, 'parquet' AS engine, 'OK' AS state, '' AS error, count(*) AS row_count FROM {t}"
        for t in testkit.TABLES
    ),
)
def source_status(spark: SparkSession, folder: str) -> DataFrame:
    """Readiness of every table, with its rows."""
    tables = testkit.load(spark, folder)
    ready = status_of(spark, "source", tables).drop("schema_name")
    return ready.join(counts_of(tables), "table_name")


# --- alignment, replacement, purge -------------------------------------------------------------------------


@register(
    "align_schema",
    f"""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice, coalesce(o_orderpriority, '5-LOW') AS o_orderpriority,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, 'new' AS o_channel, CAST(NULL AS INT) AS o_rank, 'kept' AS extra FROM {orders_n()} x""",
)
def align_schema(spark: SparkSession, folder: str) -> DataFrame:
    target = testkit.orders_nulls(testkit.load(spark, folder, "orders")["orders"])
    target = target.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    target = target.withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("extra", F.lit("kept"))
    wanted = [
        ("o_orderkey", "bigint", False), ("o_custkey", "string", True), ("o_orderstatus", "string", False),
        ("o_totalprice", "double", True), ("o_orderpriority", "string", False), ("o_orderdate", "string", True),
        ("o_channel", "string", False),
        ("o_rank", "int", True),
    ]
    return align.align_schema(target, wanted, {"o_orderpriority": "'5-LOW'", "o_channel": "'new'"})


@register(
    "fk_parent_gate",
    f"""SELECT rule_name, parent, missing_keys, CASE WHEN missing_keys > 0 THEN rule_name || ': ' || missing_keys ||
  ' reference(s) do not exist in target.' || parent || '.' ELSE '' END AS message FROM (
SELECT 'lineitem_orders' AS rule_name, 'orders' AS parent, (SELECT count(DISTINCT l_orderkey) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {ORDERS_P} o)) AS missing_keys
UNION ALL SELECT 'lineitem_part', 'part', (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) ) x
UNION ALL SELECT 'lineitem_supplier', 'supplier', NULL, 'lineitem_supplier: the parent table supplier is missing in target.'""",
)
def fk_parent_gate(spark: SparkSession, folder: str) -> DataFrame:
    t = testkit.load(spark, folder, "lineitem", "orders", "part")
    target = {"orders": testkit.orders_parents(t["orders"]), "part": t["part"]}
    return align.parent_gate(t["lineitem"], target, "lineitem", testkit.rules().foreign_keys)


@register(
    "children_gate",
    f"""SELECT rule_name, child, orphans, CASE WHEN orphans > 0 THEN rule_name || ': ' || orphans || ' row(s) of ' || child ||
  ' would lose their parent.' ELSE '' END AS message FROM (SELECT 'lineitem_orders' AS rule_name, 'lineitem' AS child,
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {ORDERS_P} o)) AS orphans) x""",
)
def children_gate(spark: SparkSession, folder: str) -> DataFrame:
    t = testkit.load(spark, folder, "lineitem", "orders")
    incoming = testkit.orders_parents(t["orders"])
    return align.children_gate(incoming, {"orders": t["orders"], "lineitem": t["lineitem"]}, "orders", testkit.rules().foreign_keys)


def scratch_store(spark: SparkSession) -> TableStore:
    """A new store in the shared folder of the session; it goes when the session ends."""
    return TableStore(spark, f"{Scratch(spark).root}/store")


@register(
    "replace_data",
    """SELECT 'orders' AS table_name, 'DATA' AS sync_type, 'COMPLETED' AS status, count(*) + 1 AS statements, count(*) AS rows_copied,
  count(*) AS source_row_count, count(*) AS target_row_count, TRUE AS data_equal FROM orders""",
)
def replace_data(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged orders are replaced by the source's; the stored result is then compared with the source."""
    t = testkit.load(spark, folder, "orders", "customer")
    store = scratch_store(spark)
    store.publish({"orders": testkit.orders_target(t["orders"]), "customer": t["customer"]})
    done = align.replace_data(t["orders"], store, "orders", testkit.rules().foreign_keys)
    after = diff.diff_counts(diff.bag_counts(t["orders"], store.read("orders")))
    return after.select(
        F.lit(done.table_name).alias("table_name"), F.lit(done.sync_type).alias("sync_type"), F.lit(done.status).alias("status"),
        F.lit(done.statements).cast("bigint").alias("statements"), F.lit(done.rows_copied).cast("bigint").alias("rows_copied"),
        "source_row_count", "target_row_count", "data_equal",
    )


@register(
    "sync_schema",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority,
  'COMPLETED' AS status, CAST(2 AS BIGINT) AS statements FROM {orders_n()} x""",
)
def sync_schema(spark: SparkSession, folder: str) -> DataFrame:
    """A stored copy with one column as text and one missing gets the source's columns; a constraint is left over."""
    orders = testkit.orders_nulls(testkit.load(spark, folder, "orders")["orders"])
    store = scratch_store(spark)
    store.publish({"orders": orders.withColumn("o_custkey", F.col("o_custkey").cast("string")).drop("o_totalprice")})
    keys = RuleSet(keys=(Key("orders_pkey", "orders", ("o_orderkey",)),))
    want = catalog_from_dataframes(spark, {"orders": orders}, keys)
    have = catalog_from_dataframes(spark, {"orders": store.read("orders")}, RuleSet())
    done = align.sync_schema(align.sync_plan(want, have), orders, store, "orders")
    return _dates_as_text(store.read("orders")).withColumns({"status": F.lit(done.status), "statements": F.lit(done.statements).cast("bigint")})


@register("audit_run", expected_findings())
def audit_run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole flow on two sides loaded by path: readiness, drift, scripts, findings, repairs. Its stored findings."""
    root, rules = Scratch(spark).root, testkit.rules()
    damaged = testkit.target_tables(testkit.load(spark, folder))
    sides = [
        load_side(spark, name, tables, catalog_from_dataframes(spark, testkit.load(spark, folder), rules))
        for name, tables in (("source", {t: f"{folder}/{t}.parquet" for t in testkit.TABLES}), ("target", damaged))
    ]
    return run_audit(spark, *sides, root).findings.withColumn("columns", F.array_join("columns", ","))


_AUDITED = f"(SELECT * FROM ({expected_findings()}) f WHERE table_name <> 'labels' AND columns <> 'o_orderpriority')"
# What the target's catalog lacks: a table with its keys, a column, a key; and one column has another type.
_AUDIT_DRIFT = {"TABLE_MISSING": ("CRITICAL", 1), "COLUMN_MISSING": ("CRITICAL", 1), "COLUMN_DIFFERENT": ("HIGH", 1), "CONSTRAINT_MISSING_OR_DIFFERENT": ("CRITICAL", 3)}


def _audit_sql() -> str:
    levels: dict[str, int] = {}
    for impact, n in _AUDIT_DRIFT.values():
        levels[impact] = levels.get(impact, 0) + n
    rows = [("differences", t, n) for t, (_, n) in _AUDIT_DRIFT.items()] + [("scripts of all", t, n) for t, (_, n) in _AUDIT_DRIFT.items()]
    rows += [("difference report", i, n) for i, n in levels.items()] + [("scripts by impact", i, n) for i, n in levels.items()]
    values = ", ".join(f"('{a}', '{label}', {n})" for a, label, n in rows)
    return f"""SELECT artifact, label, CAST(n AS BIGINT) AS n FROM (VALUES {values}) v(artifact, label, n)
UNION ALL SELECT 'findings', type || ' ' || rule_name, count FROM {_AUDITED} a
UNION ALL SELECT 'finding report', type, count(*) FROM {_AUDITED} b GROUP BY type
UNION ALL SELECT 'orphan fixes', type, count(*) FROM {_AUDITED} c WHERE type = 'FK_ORPHAN_ROWS' GROUP BY type"""


@register("audit_reports", _audit_sql())
def audit_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The whole flow on sides with unlike catalogs; every report and script is read back and its blocks are counted."""
    root, rules = Scratch(spark).root, testkit.rules()
    plain = testkit.load(spark, folder)
    other = {t: df for t, df in plain.items() if t != "labels"}
    other["orders"] = other["orders"].drop("o_orderpriority")
    other["customer"] = other["customer"].withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
    fewer = rules.for_tables(other)
    fewer = RuleSet(fewer.required, tuple(k for k in fewer.keys if k.name != "part_pkey"), fewer.foreign_keys)
    source = load_side(spark, "source", plain, catalog_from_dataframes(spark, plain, rules))
    target = load_side(spark, "target", testkit.target_tables(plain), catalog_from_dataframes(spark, other, fewer))
    audit = run_audit(spark, source, target, root)

    def blocks(artifact: str, path: str, pattern: str, label: str | None = None) -> DataFrame:
        lines = spark.read.text(f"{root}/{path}")
        found = F.regexp_extract("value", pattern, 1)
        lines = lines.filter(F.col("value").rlike(pattern)).withColumn("label", F.col(label) if label else found)
        return lines.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(artifact).alias("artifact"), "label", "n")

    script = r"^-- [0-9]+\. ([A-Z_]+)$"
    return reduce(DataFrame.unionByName, [
        audit.differences.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("differences").alias("artifact"), "label", "n"),
        audit.findings.select(F.lit("findings").alias("artifact"), F.concat_ws(" ", "type", "rule_name").alias("label"), F.col("count").alias("n")),
        blocks("difference report", "difference_report", r"^[0-9]+\. \[([A-Z]+)\] "),
        blocks("scripts of all", "scripts/all", script),
        blocks("scripts by impact", "scripts/by_impact", script, "impact"),
        blocks("finding report", "finding_report", r"^[0-9]+\. \[[A-Z]+\] ([A-Z_]+)$"),
        blocks("orphan fixes", "orphan_fixes", script),
    ])


_CLOSURE = (("customer", 0), ("orders", 1), ("events", 1), ("lineitem", 2))


@register(
    "purge_plan",
    " UNION ALL ".join(
        f"SELECT CAST({d} AS INT) AS depth, 'public' AS schema, '{t}' AS name, count(*) AS row_count FROM {t}" for t, d in _CLOSURE
    ),
)
def purge_plan(spark: SparkSession, folder: str) -> DataFrame:
    tables = testkit.load(spark, folder)
    edges = purge.rule_edges(spark, testkit.rules().foreign_keys)
    return purge.plan_rows(tables, edges, TableRef("public", "customer"))


_GONE_CUSTOMERS = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
_GONE_ORDERS = f"(SELECT o_orderkey FROM orders WHERE o_custkey IN {_GONE_CUSTOMERS})"
_LOST = {
    "customer": "c_mktsegment = 'BUILDING'", "orders": f"o_custkey IN {_GONE_CUSTOMERS}",
    "events": f"user_id IN {_GONE_CUSTOMERS}", "lineitem": f"l_orderkey IN {_GONE_ORDERS}",
}


@register(
    "purge_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (WHERE {w}) AS deleted_rows, count(*) FILTER (WHERE NOT ({w})) AS kept_rows FROM {t}"
        for t, w in _LOST.items()
    ),
)
def purge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one segment with all that refers to them."""
    tables = testkit.load(spark, folder, *_LOST)
    order = ["customer", "orders", "events", "lineitem"]
    flagged = purge.doomed_rows(tables, testkit.rules().foreign_keys, order, F.col("c_mktsegment") == "BUILDING")
    return purge.purge_counts(flagged)


def _stored_plan(spark: SparkSession, folder: str) -> tuple[TableStore, purge.PurgePlan]:
    tables = testkit.load(spark, folder, "region", *_LOST)
    store = scratch_store(spark)
    store.publish(tables)
    edges = purge.rule_edges(spark, testkit.rules().foreign_keys)
    return store, purge.store_plan(store, edges, "customer")


@register(
    "cascade_purge",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS deleted_rows, CAST(0 AS BIGINT) AS row_count FROM {t}" for t in _LOST
    )
    + " UNION ALL SELECT 'region', 0, count(*) FROM region",
)
def cascade_purge(spark: SparkSession, folder: str) -> DataFrame:
    """A stored copy is purged of customers and all that depends on them; other tables stay."""
    store, plan = _stored_plan(spark, folder)
    deleted = purge.cascade_purge(store, plan, testkit.rules().foreign_keys)
    gone = spark.createDataFrame([(t.name, n) for t, n in deleted.items()], "table_name STRING, deleted_rows BIGINT")
    left = counts_of(store.read_all()).join(gone, "table_name", "left")
    return left.select("table_name", F.coalesce("deleted_rows", F.lit(0)).alias("deleted_rows"), "row_count")


@register(
    "purge_two_schemas",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) FILTER (WHERE {w}) AS deleted_rows, count(*) FILTER (WHERE NOT ({w})) AS kept_rows FROM {t}"
        for n, t, w in (
            ("customer", "customer", _LOST["customer"]), ("orders", "orders", _LOST["orders"]), ("web.orders", "events", _LOST["events"]),
            ("web.lines", "lineitem", _LOST["lineitem"]),
        )
    ),
)
def purge_two_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """Two schemas share a table name, and tables of one depend on the other's."""
    t = testkit.load(spark, folder, *_LOST)
    tables = {"customer": t["customer"], "orders": t["orders"], "web.orders": t["events"], "web.lines": t["lineitem"]}
    keys = (
        ForeignKey("o_c", "orders", ("o_custkey",), "customer", ("c_custkey",)),
        ForeignKey("e_c", "orders", ("user_id",), "customer", ("c_custkey",), parent_schema="public", table_schema="web"),
        ForeignKey("l_o", "lines", ("l_orderkey",), "orders", ("o_orderkey",), parent_schema="public", table_schema="web"),
    )
    plan = purge.purge_plan(tables, purge.rule_edges(spark, keys), "customer")
    flagged = purge.doomed_rows(tables, keys, list(reversed(plan.order)), F.col("c_mktsegment") == "BUILDING")
    return purge.purge_counts(flagged)


@register(
    "cascade_purge_where",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (WHERE {w}) AS deleted_rows, count(*) FILTER (WHERE ({w}) IS NOT TRUE) AS row_count FROM {t}"
        for t, w in _LOST.items()
    )
    + " UNION ALL SELECT 'region', 0, count(*) FROM region",
)
def cascade_purge_where(spark: SparkSession, folder: str) -> DataFrame:
    """A stored copy loses the customers of one segment and all that refers to them, in one publish."""
    store, plan = _stored_plan(spark, folder)
    deleted = purge.cascade_purge(store, plan, testkit.rules().foreign_keys, F.col("c_mktsegment") == "BUILDING")
    gone = spark.createDataFrame([(t.name, n) for t, n in deleted.items()], "table_name STRING, deleted_rows BIGINT")
    left = counts_of(store.read_all()).join(gone, "table_name", "left")
    return left.select("table_name", F.coalesce("deleted_rows", F.lit(0)).alias("deleted_rows"), "row_count")


# Customers who answer to one another: a tree, with some answering to a later one so that loops occur.
_STAFF = (
    "SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 3 THEN c_custkey * 3 + 1 WHEN c_custkey > 0 THEN CAST(floor(c_custkey / 3) AS BIGINT) END AS boss "
    "FROM {customer}"
)


@register(
    "purge_self_reference",
    f"""WITH RECURSIVE staff AS ({_STAFF.format(customer='customer')}),
gone AS (SELECT k FROM staff WHERE k % 50 = 7 UNION SELECT s.k FROM staff s JOIN gone g ON s.boss = g.k)
SELECT 'staff' AS table_name, (SELECT count(*) FROM gone) AS deleted_rows, (SELECT count(*) FROM staff) - (SELECT count(*) FROM gone) AS kept_rows
UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_custkey IN (SELECT k FROM gone)), count(*) FILTER (WHERE o_custkey NOT IN (SELECT k FROM gone)) FROM orders""",
)
def purge_self_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Some customers with all who answer to them over any number of steps, and the orders of all these."""
    t = testkit.load(spark, folder, "customer", "orders")
    tables = {"staff": spark.sql(_STAFF, customer=t["customer"]), "orders": t["orders"]}
    keys = (ForeignKey("boss", "staff", ("boss",), "staff", ("k",)), ForeignKey("o_s", "orders", ("o_custkey",), "staff", ("k",)))
    return purge.purge_counts(purge.doomed_rows(tables, keys, ["staff", "orders"], F.col("k") % 50 == 7))


@register("cascade_drop", "SELECT 'region' AS table_name, count(*) AS row_count FROM region")
def cascade_drop(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of a stored copy after customers and all that depends on them are dropped."""
    store, plan = _stored_plan(spark, folder)
    purge.cascade_drop(store, plan)
    return counts_of(store.read_all())


# --- reports as rows ----------------------------------------------------------------------------------------


def _lines_sql(section: int, lines: list[str], rest: str = "") -> str:
    """Lines given as SQL expressions, numbered from 0."""
    listed = ", ".join(f"({i}, {line})" for i, line in enumerate(lines))
    return f"SELECT CAST({section} AS INT) AS section, CAST(position AS BIGINT) AS position, value FROM (VALUES {listed}) v(position, value) {rest}"


def _one(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SHOWN = "concat_ws(', ', " + ", ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in COLUMNS["orders"]) + ")"
_ORDER_ALL = ", ".join(f"{c} NULLS FIRST" for c in COLUMNS["orders"])
_ORDERS_DDL = (
    'CREATE TABLE "public"."orders" (\n    "o_orderkey" bigint NOT NULL,\n    "o_custkey" bigint,\n    "o_orderstatus" string NOT NULL,\n'
    '    "o_totalprice" double,\n    "o_orderdate" timestamp_ntz,\n    "o_orderpriority" string NOT NULL\n);\n\n'
    'ALTER TABLE "public"."orders" ADD CONSTRAINT "orders_customer" FOREIGN KEY (o_custkey) REFERENCES customer(c_custkey);'
)
_ORDERS_KEY = '\n\nALTER TABLE "public"."orders" ADD CONSTRAINT "orders_pkey" PRIMARY KEY (o_orderkey);'


def _difference_sql(section: int, mine: str, other: str) -> str:
    return (
        f"SELECT CAST({section} AS INT), row_number() OVER (ORDER BY {_ORDER_ALL}), {_SHOWN} FROM (SELECT * FROM {mine} a EXCEPT ALL SELECT * FROM {other} b) x "
        f"QUALIFY row_number() OVER (ORDER BY {_ORDER_ALL}) <= 20"
    )


@register(
    "report_comparison",
    "\nUNION ALL\n".join([
        "SELECT section, position, value FROM (" + _lines_sql(1, [
            "'Table comparison'", "'Table: ORDERS'", "'Direction: source -> target'", "''", "'Overall: DIFFERENT'", "'Structure: DIFFERENT'",
            "'Data: DIFFERENT'", "''", "(SELECT 'Rows in source: ' || count(*) FROM orders)", f"(SELECT 'Rows in target: ' || count(*) FROM {ORDERS_T} t)",
            f"(SELECT 'Rows only in source: ' || count(*) FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM {ORDERS_T} t) x)",
            f"(SELECT 'Rows only in target: ' || count(*) FROM (SELECT * FROM {ORDERS_T} t EXCEPT ALL SELECT * FROM orders) x)",
            f"'Columns: {', '.join(COLUMNS['orders'])}'",
        ]) + ") head",
        "SELECT 2, 1, '  [HIGH] CONSTRAINT_DIFFERENT: ''orders_pkey'' exists in source and not in target.'",
        _difference_sql(3, "orders", ORDERS_T), _difference_sql(4, ORDERS_T, "orders"),
        f"SELECT 5, 0, {_one(_ORDERS_DDL + _ORDERS_KEY)}", f"SELECT 6, 0, {_one(_ORDERS_DDL)}",
    ]),
)
def report_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a table whose rows differ and whose key the target does not declare."""
    return report.comparison_report(_compared_orders(spark, folder))


@register(
    "report_sync",
    _lines_sql(1, ["'Table synchronisation'", "'Type: DATA'", "'Table: orders'", "'Direction: source -> target'", "'Status: COMPLETED'", "''",
                   "(SELECT 'Statements: ' || (count(*) + 1) FROM orders)", "(SELECT 'Rows copied: ' || count(*) FROM orders)",
                   "'Detail: The data was replaced.'"]),
)
def report_sync(spark: SparkSession, folder: str) -> DataFrame:
    """The report of damaged orders that were replaced by the source's."""
    t = testkit.load(spark, folder, "orders", "customer")
    store = scratch_store(spark)
    store.publish({"orders": testkit.orders_target(t["orders"]), "customer": t["customer"]})
    return report.sync_report(align.replace_data(t["orders"], store, "orders", testkit.rules().foreign_keys).to_df(spark))


_CHILDREN_FIRST = sorted(_CLOSURE, key=lambda x: (-x[1], x[0]))


def _closure_sql(head: list[str], unit: str, count: str) -> str:
    """The report of customers' closure; ``count`` is a table's number, its name put in."""
    listed = [
        f"SELECT CAST(2 AS INT), CAST({i} AS BIGINT), '  {i}. public.{t}: ' || ({count.format(t=t)}) || '{unit}'" for i, (t, _) in enumerate(_CHILDREN_FIRST, 1)
    ]
    return "\nUNION ALL\n".join(["SELECT * FROM (" + _lines_sql(1, head) + ") head", *listed])


_ALL_ROWS = " + ".join(f"(SELECT count(*) FROM {t})" for t, _ in _CLOSURE)


@register(
    "report_plan",
    _closure_sql(["'Tables to be emptied'", "'Side: target'", "'Table asked for: public.customer'", "''", "'Tables: 4'", f"'Rows: ' || ({_ALL_ROWS})", "''", "'Order:'"],
                 " row(s)", "SELECT count(*) FROM {t}")
    + "\nUNION ALL SELECT * FROM (" + _lines_sql(3, ["''", "'All tables change in one publish; if anything fails nothing changes.'"]) + ") e",
)
def report_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a purge of customers that is planned."""
    return report.plan_report(purge_plan(spark, folder), "target", TableRef("public", "customer"))


_LOST_ROWS = " + ".join(f"(SELECT count(*) FROM {t} WHERE {w})" for t, w in _LOST.items())


@register(
    "report_purge",
    _closure_sql(["'Tables emptied'", "'Status: COMPLETED'", "'Side: target'", "'Table asked for: public.customer'", "''", "'Tables: 4'",
                  f"'Rows deleted: ' || ({_LOST_ROWS})", "''", "'Detail:'"], " row(s) deleted", "SELECT count(*) FROM lost_{t}"),
)
def report_purge(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a purge of the customers of one segment that is done."""
    depths = spark.createDataFrame([("public", t, d) for t, d in _CLOSURE], "schema STRING, name STRING, depth INT")
    lost = purge_counts(spark, folder).select(F.col("table_name").alias("name"), "deleted_rows")
    return report.purge_report(depths.join(lost, "name"), "target", TableRef("public", "customer"))


for _t, _w in _LOST.items():  # each table's lost rows under a name of their own
    ORACLES["report_purge"] = ORACLES["report_purge"].replace(f"FROM lost_{_t})", f"FROM {_t} WHERE {_w})")
