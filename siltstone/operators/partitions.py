"""Tables in partitioned folders whose merges rewrite the partitions that a batch touches, and no others."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder


class PartitionedTable:
    """A Parquet folder partitioned by columns that follow from the merge keys (so a row never changes its partition).

    A merge reads the partitions that its source names, writes their new rows aside, notes that in the table's folder, and
    then puts them in place (dynamic partition overwrite); partitions that are left without rows go. If it stops in between,
    the next merge() or read() finds the note and puts them in place again: what lies aside is complete. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(partition_by)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def create(self, df: DataFrame) -> None:
        df.write.partitionBy(*self.by).parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        self.recover()
        return self._rows()

    def _within(self, places: list) -> F.Column:
        if not places:
            return F.lit(False)
        if len(self.by) == 1 and all(p[0] is not None for p in places):
            return F.col(self.by[0]).isin([p[0] for p in places])
        return reduce(lambda a, b: a | b, (reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(self.by, p))) for p in places))

    def merge(self, source: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame], most: int = 10_000) -> int:
        """Replace the partitions named in `source` by work(their rows, source); how many these were. More than `most` of
        them are an error: write the table anew then, or merge in portions."""
        self.recover()
        places = source.select(*self.by).distinct().limit(most + 1).collect()
        if len(places) > most:
            raise ValueError(f"more than {most} partitions are touched")
        if not places:
            return 0
        now = self._rows().where(self._within(places))
        aside = new_folder(self.spark, "merged")
        out = work(now, source).select(*now.columns)
        out.repartition(*self.by).write.partitionBy(*self.by).parquet(aside)
        new = [f.dataType.simpleString() for f in self._rows().schema.fields if f.name in self.by]
        kept = self._at(aside, dict(zip(self.by, new)))
        gone = [str(folder) for place, folder in self._folders(now).items() if place not in kept]
        self._note({"aside": aside, "gone": gone})
        self.recover()
        return len(places)

    def _at(self, folder: str, types: dict[str, str]) -> set[tuple]:
        """The partitions that a folder has rows of."""
        fs, where = self._fs(f"{folder}/_SUCCESS")
        if not any(x.isDirectory() for x in fs.listStatus(where.getParent())):
            return set()
        return {tuple(r) for r in self.spark.read.parquet(folder).select(*(F.col(c).cast(t) for c, t in types.items())).distinct().collect()}

    def _folders(self, rows: DataFrame) -> dict[tuple, str]:
        """The folder of each partition that has rows here."""
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        return {tuple(r)[:-1]: r[-1] for r in rows.select(*self.by, folder.alias("__folder")).distinct().collect()}

    def _note(self, what: dict) -> None:
        fs, path = self._fs(f"{self.path}/_merging.tmp")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        fs.rename(path, self._fs(f"{self.path}/_merging")[1])

    def recover(self) -> bool:
        """Put in place what a merge has noted; False if there is no note."""
        fs, note = self._fs(f"{self.path}/_merging")
        if not fs.exists(note):
            return False
        read = fs.open(note)
        what = json.loads(bytes(read.readAllBytes()))
        read.close()
        self._replace(what["aside"])
        for folder in what["gone"]:
            self._fs(folder)[0].delete(self._fs(folder)[1], True)
        fs.delete(note, False)
        return True

    def _replace(self, aside: str) -> None:
        fs, where = self._fs(aside)
        if any(x.isDirectory() for x in fs.listStatus(where)):
            schema = self._rows().schema
            rows = self.spark.read.schema(schema).parquet(aside)
            rows.repartition(*self.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.path)

    def sink(self, work: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch is merged into the partitions that it touches. `work` must be idempotent, as a
        batch may come again."""
        return lambda batch, batch_id: self.merge(batch, work) and None
