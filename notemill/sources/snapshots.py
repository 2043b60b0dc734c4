"""An index on disk: each refresh writes a new version beside the old ones, and a small file names the current one.

A version is complete before it becomes current, so readers never see a half-written index and a failed refresh changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        p = self._path(f"{self.path}/done")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def write(self, **tables: DataFrame) -> int:
        """Writes tables as the next version. They may read the current one."""
        version = (self.versions() or [-1])[-1] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        self._fs.create(self._path(f"{self.path}/done/{version}"), True).close()
        return version

    def read(self, name: str) -> DataFrame | None:
        """A table of the current version; None if there is no version yet."""
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{done[-1]}/{name}") if done else None

    def prune(self, keep: int = 2) -> None:
        """Drops all but the latest versions."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.path}/done/{v}"), False)
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)
