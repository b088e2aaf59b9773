"""A log of runs as append-only events, temporary tables, and a sequence of keys."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .dedup import latest

RUNNING, SUCCESS, FAIL, STALE = "RUNNING", "SUCCESS", "FAIL", "STALE"
EVENTS = "run_id string, process_name string, status string, at timestamp, note string, metrics string"
EPOCH = datetime(1900, 1, 1)


class RunLog:
    """Runs of processes: each event is a row, a run's state is its latest status. Nothing is ever updated.

    One run of a process at a time unless `concurrent`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = None

    def _add(self, run_id: str, process: str, status: str | None, note: str | None = None, metrics: dict | None = None, at: datetime | None = None) -> None:
        now = at or datetime.now(timezone.utc).replace(tzinfo=None)
        if self._at and now <= self._at:
            now = self._at.replace(microsecond=self._at.microsecond + 1) if self._at.microsecond < 999_999 else now
        self._at = now
        row = (run_id, process, status, now, note, json.dumps(metrics) if metrics else None)
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        from ..sources.files import _maybe

        df = _maybe(self.spark, self.path, EVENTS)
        return df if df is not None else self.spark.createDataFrame([], EVENTS)

    def runs(self) -> DataFrame:
        """run_id, process_name, status, start_time, end_time, duration_seconds, notes, metrics (latest)."""
        return self.events().groupBy("run_id", "process_name").agg(
            F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at"))).alias("status"), F.min("at").alias("start_time"), F.max(F.when(F.col("status").isin(SUCCESS, FAIL, STALE), F.col("at"))).alias("end_time"),
            F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("at", "note")))).alias("notes"), F.max_by("metrics", F.when(F.col("metrics").isNotNull(), F.col("at"))).alias("metrics"),
        ).withColumn("duration_seconds", (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6)

    def start(self, process: str, concurrent: bool = False, at: datetime | None = None) -> str:
        if not concurrent and not self.runs().where((F.col("process_name") == process) & (F.col("status") == RUNNING)).isEmpty():
            raise RuntimeError(f"{process} is running")
        run_id = uuid.uuid4().hex
        self._add(run_id, process, RUNNING, at=at)
        return run_id

    def finish(self, run_id: str, status: str = SUCCESS, note: str | None = None, metrics: dict | None = None, at: datetime | None = None) -> None:
        if status not in (SUCCESS, FAIL, STALE):
            raise ValueError(status)
        self._add(run_id, self._process(run_id), status, note, metrics, at)

    def note(self, run_id: str, text: str | None = None, **metrics) -> None:
        self._add(run_id, self._process(run_id), None, text, metrics)

    def _process(self, run_id: str) -> str:
        row = self.events().where(F.col("run_id") == run_id).select("process_name").first()
        if row is None:
            raise KeyError(run_id)
        return row[0]

    def clean(self, older_than: datetime) -> list[str]:
        """Mark runs as stale that started before and never ended."""
        rows = self.runs().where((F.col("status") == RUNNING) & (F.col("start_time") < F.lit(older_than))).select("run_id", "process_name").collect()
        for r in rows:
            self._add(r[0], r[1], STALE)
        return [r[0] for r in rows]

    def last(self, process: str, status: str | None = None):
        """The row of the latest run (of a status), or None."""
        rows = self.runs().where(F.col("process_name") == process)
        rows = rows.where(F.col("status") == status) if status else rows
        return latest(rows, ["process_name"], "start_time", "run_id").first()

    def watermark(self, process: str, status: str = SUCCESS, end: bool = False) -> datetime:
        """When the latest run of a status started (or ended); 1900-01-01 without one."""
        row = self.last(process, status)
        return (row["end_time" if end else "start_time"] if row else None) or EPOCH


class TempTables:
    """Parquet tables that live with a scope: a session, a user, or a name of the caller's."""

    def __init__(self, spark: SparkSession, path: str, scope: str | None = None):
        self.spark, self.scope = spark, scope or uuid.uuid4().hex
        self.path = f"{path.rstrip('/')}/{self.scope}"

    def save(self, name: str, df: DataFrame, append: bool = False) -> DataFrame:
        df.write.mode("append" if append else "overwrite").parquet(f"{self.path}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str | None = None) -> bool:
        """Remove one table, or all of this scope."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


SESSION, CODE_PATH_USER, USER = "SESSION", "CODE_PATH_USER", "USER"


class OwnedTables:
    """Temporary Parquet tables under one name for all, each owned by who wrote it last: a session of a user, from a code path.

    The session that owns a table may append to it, overwrite and drop it. Another session may overwrite or drop it, and so
    take it over, if `scope` says so: SESSION never, CODE_PATH_USER for the same user and code path, USER for the same user;
    anything else is a PermissionError, unless `force`. A table changes hands when its owner file is written, before its rows
    are; a table without one belongs to nobody.
    """

    def __init__(self, spark: SparkSession, path: str, session: str, user: str, code_path: str = "", scope: str = SESSION):
        if scope not in (SESSION, CODE_PATH_USER, USER):
            raise ValueError(scope)
        self.spark, self.path, self.scope = spark, path.rstrip("/"), scope
        self.me = {"session": session, "user": user, "code_path": code_path}

    def _file(self, name: str, *more: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, name, *more]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def owner(self, name: str) -> dict | None:
        fs, path = self._file(name, "_owner")
        if not fs.exists(path):
            return None
        read = fs.open(path)
        try:
            return json.loads(bytes(read.readAllBytes()))
        finally:
            read.close()

    def _may(self, name: str, force: bool) -> bool:
        """True if the table is this session's already; an error if it is another's and the scope doesn't allow to take it."""
        owner = self.owner(name)
        if owner is None or owner["session"] == self.me["session"]:
            return owner is not None
        same = {SESSION: (), CODE_PATH_USER: ("user", "code_path"), USER: ("user",)}[self.scope]
        if not force and not (same and all(owner[k] == self.me[k] for k in same)):
            raise PermissionError(f"{name} belongs to session {owner['session']} of {owner['user']}")
        return False

    def save(self, name: str, df: DataFrame, append: bool = False, force: bool = False) -> DataFrame:
        """Write a table and own it. Rows are appended to a table of one's own alone; one taken over is overwritten."""
        own = self._may(name, force)
        fs, path = self._file(name, "_owner")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(self.me).encode()))
        out.close()
        df.write.mode("append" if append and own else "overwrite").parquet(f"{self.path}/{name}/rows")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/rows")

    def drop(self, name: str, force: bool = False) -> bool:
        self._may(name, force)
        fs, path = self._file(name)
        return fs.delete(path, True)

    def mine(self) -> list[str]:
        """Tables of this session."""
        fs, top = self._file("")
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in names if (self.owner(n) or {}).get("session") == self.me["session"])

    def drop_mine(self) -> list[str]:
        return [n for n in self.mine() if self.drop(n)]


def with_keys(df: DataFrame, column: str, after: int, order: list[str]) -> DataFrame:
    """New rows numbered from `after` + 1 in a fixed order: counted by range partition, so no task gets all rows.

    The ranged rows are written once and read twice, for their counts and for the rows: two evaluations would take two samples
    and might draw the ranges differently. Rows that are equal in `order` are numbered in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    ranged = written(ranged, "ranged")
    n = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    before = n.select("__p", "first", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row for each range
    return ranged.join(F.broadcast(before), "__p").withColumn(column, F.col("__i") - F.col("first") + F.col("before") + after + 1).drop("__p", "__i", "first", "before")
