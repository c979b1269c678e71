"""Where lineage is cut: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="tablecheck-checkpoints-")
    context.setCheckpointDir(folder)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end, for steps of which only what they wrote is used.

    Otherwise the files stay until the driver happens to collect its garbage, and the disk holds those of all steps together.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables written below the shared folder so that later steps start from files. They are removed on request, or by
    Hadoop when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)

    def keep(self, df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        """Write a frame, with a folder per value of ``partition``, and go on from its files."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_removed(self.spark):
            (df.write.partitionBy(partition) if partition else df.write).parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        self._fs.delete(self._path, True)
