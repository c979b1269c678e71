"""Versions of Parquet tables that become visible together.

A publish writes each table to a directory of its own and then writes one manifest that names the
current directory of every table; readers go through the newest manifest. Until the manifest's
rename nothing changes for them, so a job that fails leaves the tables as they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest version, 0 for an empty store."""
        return (self._manifests() or [0])[-1]

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Directory of every table, in the newest version by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{version}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest()[table])

    def read_all(self, version: int | None = None) -> dict[str, DataFrame]:
        return {t: self.spark.read.parquet(p) for t, p in sorted(self.manifest(version).items())}

    def stage(self, table: str, df: DataFrame) -> str:
        """Write rows for a table that nobody sees yet; the path can be checked, then published or discarded."""
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def discard(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def publish(
        self, tables: Mapping[str, DataFrame | str], drop: Sequence[str] = (), after: int | None = None
    ) -> dict[str, int]:
        """Write new versions of tables (or take staged ones), remove others, and show all of it at once; rows per table.

        With ``after`` it is the successor of that version, and fails if there has been another publish since.
        """
        after = self.version() if after is None else after
        current = self.manifest(after)
        rows = {}
        for table, df in tables.items():
            path = df if isinstance(df, str) else self.stage(table, df)
            # Counted from the files' footers: what was written, whatever tasks had to run twice.
            rows[table] = self.spark.read.parquet(path).count()
            current[table] = path
        for table in drop:
            del current[table]
        self._commit(current, after + 1)
        return rows

    def _commit(self, manifest: Mapping[str, str], version: int) -> None:
        final = self._path(f"{self.root}/_manifest/{version}.json")
        draft = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(dict(manifest), sort_keys=True).encode()))
        finally:
            out.close()
        # rename refuses to replace a file, so of two writers of one version the second fails.
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"Another publish took version {version}: nothing was changed.")
