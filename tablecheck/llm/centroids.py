"""Centroid clustering of integer vectors with exact dot products that are carried from round to round.

Every vector is kept with its exact dot product with each centroid. When a centroid moves, only the components that
changed are multiplied with the vector and added to its product; distances compare as ``|c|^2 - 2 c.v``, so a round touches no
component of a centroid that stayed. All numbers are integers, so nothing drifts and reruns agree.

A round reads the written state and writes the next one, with one more row per task that holds the task's sums per cluster;
the sums of all tasks are a few hundred numbers. A lost executor costs a task's read. The state before the last is removed.
Rounds end early when no centroid moves, since later ones would change nothing.

Vectors with another number of components, with a NULL or with one that is not finite are left out. Rows with a NULL id are
clustered like others but begin no centroid unless too few others are there; repeated rows count as often as they occur. With
fewer vectors than clusters there are as many clusters as vectors. An empty table gives an empty result. A component of
131072 or more either way cannot be squared and added in a long and ends the query with an error. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tablecheck.llm.staging import discard, new_folder, write

CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Components beyond this do not leave room for a squared distance in a long.
LARGEST = 1 << 27


def _integers(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(``id``, ``v``): the vectors that are kept, in whole numbers."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    kept = vectors.filter((F.size(v) == dims) & finite)
    large = F.exists(v, lambda x: F.abs(x.cast("double")) >= LARGEST // SCALE)
    checked = F.when(large, F.raise_error(F.lit("a component is too large for exact squared distances")).cast("array<bigint>")).otherwise(whole)
    return kept.select(F.col(id_col).alias("id"), checked.alias("v"))


def _starts(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hash of their id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(clusters)
    return np.array([r["v"] for r in first.collect()], dtype=np.int64)


def _kind(id_field: StructField) -> StructType:
    return StructType([
        id_field, StructField("v", BinaryType()), StructField("dots", BinaryType()), StructField("cluster", IntegerType()),
        StructField("distance", LongType()), StructField("sums", BinaryType()),
    ])


def _assigned(state: DataFrame, moves: np.ndarray, centroids: np.ndarray, kind: StructType) -> DataFrame:
    """The next state: dot products after the centroids moved by ``moves``, nearest centroid and distance.

    A task's last row has ``sums``: for each cluster the sum of its vectors, their number and the sum of their distances.
    """
    clusters, dims = centroids.shape
    norms = (centroids * centroids).sum(axis=1)
    changed = [(j, np.flatnonzero(moves[j])) for j in range(clusters)]
    changed = [(j, at, moves[j, at]) for j, at in changed if len(at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, batch = np.zeros((clusters, dims + 2), dtype=np.int64), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if "dots" in batch.schema.names:
                v = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<i4").reshape(n, dims).astype(np.int64)
                dots = np.frombuffer(b"".join(batch.column("dots").to_pylist()), dtype="<i8").reshape(n, clusters).copy()
            else:
                v = np.asarray(batch.column("v").flatten(), dtype=np.int64).reshape(n, dims)
                dots = np.zeros((n, clusters), dtype=np.int64)
            for j, at, by in changed:
                dots[:, j] += v[:, at] @ by
            score = norms - 2 * dots
            cluster = score.argmin(axis=1)  # the first of equally near ones
            distance = (v * v).sum(axis=1) + score[np.arange(n), cluster]
            for j in range(clusters):
                own = cluster == j
                total[j, :dims] += v[own].sum(axis=0)
                total[j, dims:] += own.sum(), distance[own].sum()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()), pa.array([x.tobytes() for x in dots], pa.binary()),
                pa.array(cluster.astype(np.int32)), pa.array(distance), pa.nulls(n, pa.binary()),
            ], names=kind.names)
        if batch is not None:
            none = [pa.nulls(1, t) for t in (batch.schema.field(0).type, pa.binary(), pa.binary(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([total.astype("<i8").tobytes()], pa.binary())], names=kind.names)

    return state.mapInArrow(run, kind)


def _totals(state: DataFrame, clusters: int, dims: int) -> np.ndarray:
    """Per cluster the sum of its vectors, their number and the sum of their distances, over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(clusters * (dims + 2), dtype=np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                total += np.frombuffer(held, dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

    parts = state.filter("sums IS NOT NULL").select("sums").mapInArrow(run, "at long, n long")
    total = np.zeros(clusters * (dims + 2), dtype=np.int64)
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # clusters * (dims + 2) numbers
        total[r["at"]] = r["n"]
    return total.reshape(clusters, dims + 2)


def clustered(
    vectors: DataFrame, dims: int = 64, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(vectors, centroids, inertias). ``vectors`` has the id, ``cluster`` and ``distance`` (squared) after ``rounds`` rounds;
    ``inertias`` are the distances summed per cluster."""
    spark: SparkSession = vectors.sparkSession
    whole = _integers(vectors, dims, id_col, vector_col)
    centroids = _starts(whole, clusters, seed)
    k = len(centroids)
    kind = _kind(whole.schema["id"])
    if not k:
        return spark.createDataFrame([], kind).select(F.col("id").alias(id_col), "cluster", "distance"), np.zeros((0, dims), dtype=np.int64), np.zeros(0, dtype=np.int64)
    state, moves, old = whole, centroids, None
    for done in range(rounds + 1):
        path = new_folder(spark, "centroids")
        write(_assigned(state, moves, centroids, kind), path, "zstd")
        if old:
            discard(spark, old)
        old, written = path, spark.read.schema(kind).parquet(path)
        total = _totals(written, k, dims)
        state = written.filter("sums IS NULL").select("id", "v", "dots")
        count = total[:, dims]
        new = np.where(count[:, None] > 0, total[:, :dims] // np.maximum(count, 1)[:, None], centroids)
        if done == rounds or not (moves := new - centroids).any():
            break
        centroids = new
    return written.filter("sums IS NULL").select(F.col("id").alias(id_col), "cluster", "distance"), centroids, total[:, dims + 1]


def with_summary(found: DataFrame, centroids: np.ndarray, inertias: np.ndarray) -> DataFrame:
    """``cluster_inertia``, ``inertia`` and ``centroid_sha256`` beside each vector; one number and digest per cluster."""
    if not len(centroids):
        zero = F.lit(None).cast("long")
        return found.withColumns({"cluster_inertia": zero, "inertia": zero, "centroid_sha256": F.lit(None).cast("string")})
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = F.col("cluster") + 1
    return found.withColumns({
        "cluster_inertia": F.element_at(F.array(*[F.lit(n).cast("long") for n in inertias.tolist()]), per),
        "inertia": F.lit(sum(inertias.tolist())).cast("long"),
        "centroid_sha256": F.element_at(F.array(*[F.lit(d) for d in digests]), per),
    })
