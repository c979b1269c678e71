"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablecheck.sources.checkpoints import ensure_checkpoint_dir


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, removed by Hadoop when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return path


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a frame once and go on from the files: a lost executor then costs a read, not the work before."""
    path = new_folder(df.sparkSession, name)
    write(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, compression: str | None = None) -> None:
    (df.write.option("compression", compression) if compression else df.write).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``new_folder`` that nothing reads any more."""
    place, files = _place(spark, path)
    files.delete(place, True)
