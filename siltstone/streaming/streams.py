"""Structured Streaming: ingest once, merge by micro-batch, windows over event time, progress."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.dedup import latest
from ..operators.merge import apply_changes, merge_changes, scd2_merge, upsert
from ..operators.snapshots import Snapshots


def drain(df: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", timeout: int = 600) -> None:
    """Process all that is there, from the checkpoint on, into a Parquet folder or by a function of each batch."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"{checkpoint} didn't end in {timeout} s")
    finally:
        query.stop()


def start(df: DataFrame, checkpoint: str, trigger: str = "available now", path: str | None = None, table: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", name: str | None = None):
    """A running query into a Parquet folder, a table, or a function of each batch.

    trigger: "available now" (all that is there, in batches of the source's size, then it ends), "once" (all that is there as
    one batch), or an interval such as "10 seconds" (until it is stopped).
    """
    if sum(x is not None for x in (path, table, each)) != 1:
        raise ValueError("pass one of path, table and each")
    when = {"available now": {"availableNow": True}, "once": {"once": True}}.get(trigger, {"processingTime": trigger})
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(**when)
    writer = writer.queryName(name) if name else writer
    if table is not None:
        return writer.toTable(table)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)


class TimeLedger:
    """Which times of a source have been processed: a run takes the rows of times that no run before has recorded.

    Rows that come late for a recorded time are not seen again, as in a ledger by time; sources with late rows need a
    watermark or versions instead. Record after the rows have been written: a run that stops before is done again, so its
    target should be written by time (overwriting that time's rows).
    """

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path, column

    def pending(self, df: DataFrame) -> DataFrame:
        from ..sources.files import _maybe

        done = _maybe(self.spark, self.path)
        return df.where(F.col(self.column).isNotNull()) if done is None else df.join(done.select(self.column), self.column, "left_anti").where(F.col(self.column).isNotNull()).select(*df.columns)

    def record(self, df: DataFrame) -> None:
        """Add the times of these rows, each once."""
        self.pending(df).select(self.column).distinct().withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(self.path)


def timed(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event times with a zone, as watermarks need them."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def json_path_stream(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]], glob: str | None = None) -> DataFrame:
    """Lines of JSON as columns {name: (path, type)}; one such stream for each file glob multiplexes a folder."""
    lines = spark.readStream.option("pathGlobFilter", glob or "*").text(path)
    return lines.select(*(F.get_json_object("value", p).cast(t).alias(c) for c, (p, t) in fields.items()), F.col("_metadata.file_path").alias("file_path"))


class MergeSink:
    """A batch function that merges micro-batches into a table of snapshots; a batch that comes again changes nothing
    that it has not changed already, as all of these merges are idempotent."""

    def __init__(self, table: Snapshots, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame):
        self.table, self.merge, self.empty = table, merge, empty

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self.table.read() if self.table.versions() else self.empty
        self.table.write(self.merge(now, batch), f"batch {batch_id}")


def scd1_sink(table: Snapshots, empty: DataFrame, keys: Sequence[str], time: str) -> MergeSink:
    return MergeSink(table, lambda now, batch: apply_changes(now, batch, keys, time), empty)


def upsert_sink(table: Snapshots, empty: DataFrame, keys: Sequence[str], time: str) -> MergeSink:
    return MergeSink(table, lambda now, batch: upsert(now, latest(batch, keys, time), keys, check=False), empty)


def scd2_sink(table: Snapshots, empty: DataFrame, keys: Sequence[str], time: str, **options) -> MergeSink:
    return MergeSink(table, lambda now, batch: scd2_merge(now, batch, keys, time, **options), empty)


def changes_sink(table: Snapshots, empty: DataFrame, keys: Sequence[str], time: str) -> MergeSink:
    return MergeSink(table, lambda now, batch: merge_changes(now, batch, keys, time), empty)


class VersionCheckpoint:
    """How far a reader of a table's versions has come; a row is added only when it has moved on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self) -> int:
        from ..sources.files import _maybe

        df = _maybe(self.spark, self.path, "version long, at timestamp")
        return -1 if df is None else df.agg(F.max("version")).first()[0]

    def advance(self, version: int) -> bool:
        if version <= self.get():
            return False
        self.spark.createDataFrame([(version,)], "version long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)
        return True


def windowed(df: DataFrame, time: str, late: str, size: str, aggregates: dict[str, Column], keys: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Aggregates {name: column} over tumbling or sliding windows of event time, of a stream or a batch; rows later than `late` are
    dropped by streams."""
    dated = df.withWatermark(time, late)
    return dated.groupBy(F.window(time, size, slide or size).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, late: str, gap: str, aggregates: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    dated = df.withWatermark(time, late)
    return dated.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


class ProgressLog(StreamingQueryListener):
    """Progress of all queries as rows: kept here, or handed to `sink`."""

    def __init__(self, sink: Callable[[dict], None] | None = None):
        self.rows: list[dict] = []
        self.sink = sink or self.rows.append

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.sink({"id": str(p.id), "run_id": str(p.runId), "name": p.name, "batch_id": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond, "trigger_ms": (p.durationMs or {}).get("triggerExecution")})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress_rates(progress: DataFrame) -> DataFrame:
    """Batches, rows and mean rows a second of each query."""
    return progress.groupBy("id", "name").agg(F.count("*").alias("batches"), F.sum("input_rows").alias("input_rows"), F.round(F.avg("rows_a_second"), 4).alias("mean_rows_a_second"))


def place_streams(jobs: DataFrame, new: DataFrame, most: int = 6) -> DataFrame:
    """Give new event names a job: free places of the jobs with the fewest (job, events array) first, then new jobs of
    `most` each. Job and event lists are configuration: hundreds of rows."""
    from pyspark.sql import Window

    taken = jobs.select(F.explode("event_names").alias("event_name"))
    fresh = new.join(taken, "event_name", "left_anti").distinct().withColumn("place", F.row_number().over(Window.orderBy("event_name")))
    free = jobs.select("job_name", F.size("event_names").alias("used")).where(F.col("used") < most)
    slots = free.withColumn("slot", F.explode(F.sequence(F.col("used") + 1, F.lit(most)))).withColumn("place", F.row_number().over(Window.orderBy("used", "job_name", "slot"))).select("place", "job_name")
    placed = fresh.join(slots, "place", "left")
    left = F.row_number().over(Window.partitionBy(F.col("job_name").isNull()).orderBy("place"))
    return placed.withColumn("number", F.ceil(left / most)).select("event_name", F.coalesce("job_name", F.concat(F.lit("new_job_"), F.col("number"))).alias("job_name"), F.col("job_name").isNull().alias("is_new"))
