"""Loading the two sides, checking that they can be read, counting rows, resolving names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions.text import quote_name
from tablecheck.functions.unions import balanced_union
from tablecheck.model import Catalog, Side

STATUS_DDL = "side STRING, table_name STRING, engine STRING, schema_name STRING, state STRING, error STRING"

# URL scheme -> engine name.
ENGINES = {
    "postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "sqlserver": "sqlserver",
    "mssql": "sqlserver",
}


def engine_of(url: str) -> str:
    """Engine of a JDBC URL."""
    scheme = url.strip().removeprefix("jdbc:").split(":", 1)[0].lower()
    if scheme not in ENGINES:
        raise ValueError(f"Unsupported engine '{scheme}'.")
    return ENGINES[scheme]


def jdbc_options(
    url: str, table: str, *, user: str = "", password: str = "", fetch_size: int = 10_000,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1,
) -> dict[str, str]:
    """Reader options; with a partition column and bounds the read is split over ``partitions`` tasks."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    if partition_column and bounds:
        options.update(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return options


def read_table(spark: SparkSession, source: str | Mapping[str, str] | DataFrame) -> DataFrame:
    """A DataFrame, a path to Parquet, a catalog table name, or JDBC options."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Mapping):
        return spark.read.format("jdbc").options(**source).load()
    if "/" in source or source.endswith(".parquet"):
        return spark.read.parquet(source)
    return spark.read.table(source)


def read_splits(spark: SparkSession, options: Mapping[str, str], predicates: Sequence[str]) -> DataFrame:
    """A database table read by one task per predicate; see :func:`split_predicates`."""
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=list(predicates), properties=rest)


def split_predicates(df: DataFrame, columns: Sequence[str], splits: int, engine: str = "postgresql") -> list[str]:
    """About ``splits`` conditions, each for a like share of the rows; every row, NULL keys included, meets exactly one.

    The first column is cut at its approximate quantiles, so crowded stretches get more splits than equal widths would give
    them. A value (or NULL) that fills more than one split is one on its own, and is cut further by the next column.
    ``df`` is the table or an earlier copy of it; what comes back are a few values per column, written as literals of ``engine``.
    Columns are numbers, dates or timestamps.
    """
    if splits < 2 or not columns:
        return []
    column, accuracy = columns[0], 100 * splits
    at = F.array(*[F.lit(k / splits) for k in range(1, splits)])
    value = F.col(f"`{column}`")
    row = df.agg(F.percentile_approx(value, at, F.lit(accuracy)).alias("points"), F.count("*").alias("n"), F.count_if(value.isNull()).alias("nulls")).first()
    points, total, nulls = row["points"] or [], row["n"], row["nulls"]
    name = quote_name(column, engine)
    times = {p: points.count(p) for p in sorted(set(points))}
    heavy = {p: n for p, n in times.items() if n > 1}

    def within(own: Column, condition: str, parts: int) -> list[str]:
        more = split_predicates(df.filter(own), columns[1:], parts, engine) if parts > 1 else []
        return [f"{condition} AND {m}" for m in more] or [condition]

    out, low = [], None  # low: the lower end so far, as a condition
    for p in times:
        below = f"{name} < {_literal(p)}"
        out.append(f"{low} AND {below}" if low else below)
        if p in heavy:
            out += within(value == F.lit(p), f"{name} = {_literal(p)}", heavy[p] + 1)
            low = f"{name} > {_literal(p)}"
        else:
            low = f"{name} >= {_literal(p)}"
    out.append(low or f"{name} IS NOT NULL")
    if nulls:
        share = max(1, round(splits * nulls / total))
        out += within(value.isNull(), f"{name} IS NULL", share)
    return [f"({c})" for c in out]


def _literal(value) -> str:
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def overwrite_jdbc(df: DataFrame, options: Mapping[str, str]) -> None:
    """Replace the rows of a database table, keeping its definition, indexes and grants."""
    df.write.format("jdbc").options(**options).option("truncate", "true").mode("overwrite").save()


def load_side(
    spark: SparkSession, name: str, tables: Mapping[str, str | Mapping[str, str] | DataFrame],
    catalog: Catalog | None = None, schema: str = "public", engine: str = "parquet",
) -> Side:
    return Side(name, {t: read_table(spark, s) for t, s in tables.items()}, catalog, schema, engine)


def scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, in the order named; the reader fetches nothing else."""
    return df.select(*[f"`{c}`" for c in columns])


def source_status(
    spark: SparkSession, name: str, tables: Mapping[str, str | Mapping[str, str] | DataFrame],
    schema: str = "public", engine: str = "parquet",
) -> DataFrame:
    """Per table whether a row of it can be read, and the error if not.

    All tables are tried by one job; only if that fails is each tried alone, to tell which.
    """
    rows, probes = [], {}
    for table, source in sorted(tables.items()):
        try:
            # All values of one row are computed, as text that is thrown away.
            probes[table] = read_table(spark, source).limit(1).select(F.to_json(F.struct("*")).alias("row"))
            rows.append((name, table, engine, schema, "OK", ""))
        except Exception as error:  # any failure to read is what this reports
            rows.append((name, table, engine, schema, "ERROR", _first_line(error)))
    try:
        if probes:
            balanced_union(list(probes.values())).write.format("noop").mode("overwrite").save()
    except Exception:
        rows = [r if r[4] == "ERROR" else (*r[:4], *_tried(probes[r[1]])) for r in rows]
    return spark.createDataFrame(rows, STATUS_DDL)


def _first_line(error: Exception) -> str:
    return str(error).split("\n", 1)[0]


def _tried(probe: DataFrame) -> tuple[str, str]:
    try:
        probe.write.format("noop").mode("overwrite").save()
    except Exception as error:
        return "ERROR", _first_line(error)
    return "OK", ""


def all_ready(*statuses: DataFrame) -> bool:
    return all(s.filter("state = 'ERROR'").isEmpty() for s in statuses)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of many tables as one job."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t, df in sorted(tables.items())
    ]
    return balanced_union(counts)


def resolve_tables(catalog: Catalog, requests: DataFrame, column: str = "requested") -> DataFrame:
    """Requested names matched to tables: the exact name, else the only one that differs in case.

    Gives ``requested, table_name, state`` with state OK, MISSING or AMBIGUOUS. Names are folded to
    a summary per lower-case spelling first, so many requests cost one join.
    """
    known = catalog.tables.select(F.col("table_name").alias("known"), F.lower("table_name").alias("folded"))
    wanted = requests.select(F.col(column).alias("requested")).distinct()
    wanted = wanted.withColumn("folded", F.lower("requested"))
    folded = known.groupBy("folded").agg(F.count("*").alias("n"), F.min("known").alias("single"))
    exact = known.select(F.col("known").alias("exact"))
    joined = wanted.join(folded, "folded", "left").join(exact, F.col("requested") == F.col("exact"), "left")
    state: Column = (
        F.when(F.col("exact").isNotNull() | (F.col("n") == 1), "OK")
        .when(F.col("n") > 1, "AMBIGUOUS")
        .otherwise("MISSING")
    )
    found = F.coalesce(F.col("exact"), F.when(F.col("n") == 1, F.col("single")))
    return joined.select("requested", found.alias("table_name"), state.alias("state"))


def resolve_name(catalog: Catalog, table: str, side: str) -> str:
    """One name, with an error when it is unknown or ambiguous."""
    wanted = table.strip()
    if not wanted:
        raise ValueError("No table name was given.")
    same = catalog.tables.filter(F.lower("table_name") == F.lower(F.lit(wanted)))
    exact = same.filter(F.col("table_name") == wanted)
    if not exact.isEmpty():
        return wanted
    matches = [r.table_name for r in same.select("table_name").limit(2).collect()]
    if not matches:
        raise ValueError(f"{side} has no table '{wanted}'.")
    if len(matches) > 1:
        raise ValueError(f"'{wanted}' fits more than one table in {side}; only the exact spelling can tell which.")
    return matches[0]
