"""Versions of a table as plain folders: each version is a Parquet folder that Spark wrote as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import latest


class Snapshots:
    """Versions under `path`/version=N. Spark's own committer makes a version appear as a whole (_SUCCESS).

    One writer at a time; readers see finished versions only. Each version holds all rows: right for dimensions and
    aggregates. Facts should be partitioned, and rewritten by partition (see write_partitions).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version:08d}"

    def _where(self, path: str):
        return self._hadoop.Path(path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._where(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._where(self.path))]
        return sorted(v for v in (int(n.split("=")[1]) for n in names if n.startswith("version=")) if self._fs.exists(self._where(f"{self._at(v)}/_SUCCESS")))

    def latest(self) -> int | None:
        return (self.versions() or [None])[-1]

    def write(self, df: DataFrame, operation: str = "write", partition_by: tuple[str, ...] = ()) -> int:
        """Add a version; df may read from older ones."""
        known = self.versions()
        version = known[-1] + 1 if known else 0
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self._at(version))
        note = self.spark.createDataFrame([(version, operation)], "version long, operation string").withColumn("written_at", F.current_timestamp())
        note.coalesce(1).write.mode("append").json(f"{self.path}/_history")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        version = known[-1] if version is None and known else version
        if version not in known:
            raise ValueError(f"no version {version} in {self.path}")
        return self.spark.read.parquet(self._at(version))

    def history(self) -> DataFrame:
        """version, operation, written_at of the versions that are there."""
        notes = self.spark.read.schema("version long, operation string, written_at timestamp").json(f"{self.path}/_history")
        return latest(notes.where(F.col("version").isin(self.versions())), ["version"], "written_at").orderBy("version")

    def changes(self, start: int, keys: list[str], end: int | None = None) -> DataFrame:
        """Change rows of all versions after `start`, with _commit_version."""
        from .merge import changes_between

        steps = [v for v in self.versions() if v >= start and (end is None or v <= end)]
        out = None
        for a, b in zip(steps[:-1], steps[1:]):
            rows = changes_between(self.read(a), self.read(b), keys).withColumn("_commit_version", F.lit(b).cast("long"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            out = self.read(steps[-1]).limit(0).withColumn("_change_type", F.lit("")).withColumn("_commit_version", F.lit(0).cast("long"))
        return out

    def restore(self, version: int) -> int:
        return self.write(self.read(version), f"restore {version}")

    def clone(self, path: str, version: int | None = None) -> Snapshots:
        other = Snapshots(self.spark, path)
        other.write(self.read(version), "clone")
        return other

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete all but the newest `keep` versions."""
        gone = self.versions()[:-keep] if keep else self.versions()
        for v in gone:
            self._fs.delete(self._where(self._at(v)), True)
        return gone

    def publish(self, view: str, rules: list[Callable[[DataFrame], Column]]) -> int:
        """Point a view at the newest version for which all rules (aggregates that must be true) hold."""
        for v in reversed(self.versions()):
            df = self.read(v)
            row = df.agg(*(r(df).alias(f"r{i}") for i, r in enumerate(rules))).first() if rules else ()
            if all(row):
                df.createOrReplaceTempView(view)
                return v
        raise ValueError("no version satisfies all rules")

    def guarded(self, work: Callable[[Snapshots], None]) -> int | None:
        """Run work; if it raises, take away the versions that it wrote, so that the newest is that of before."""
        before = set(self.versions())
        try:
            work(self)
        except Exception:
            for v in set(self.versions()) - before:
                self._fs.delete(self._where(self._at(v)), True)
            raise
        return self.latest()


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
