"""Where metrics and alerts go: the console, a table, or a sender that is handed in."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import row_hash
from ..sources.files import _maybe


class MetricSink(Protocol):
    def write(self, metrics: dict[str, object], tags: dict[str, str]) -> None: ...


class ConsoleSink:
    def write(self, metrics: dict[str, object], tags: dict[str, str]) -> None:
        print(json.dumps({"metrics": metrics, "tags": tags}, default=str, sort_keys=True))


class SeriesSink:
    """One point for each numeric metric, sent by `send` (such as an HTTP call)."""

    def __init__(self, send: Callable[[list[dict]], None]):
        self.send = send

    def write(self, metrics: dict[str, object], tags: dict[str, str]) -> None:
        self.send([{"metric": k, "value": float(v), "tags": tags} for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)])


class TableSink:
    """Rows of name, number (null if it is none), text and tags, appended to a Parquet folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, metrics: dict[str, object], tags: dict[str, str]) -> None:
        def number(v: object) -> float | None:
            try:
                return float(v)  # type: ignore[arg-type]
            except (TypeError, ValueError):
                return None

        rows = [(k, number(v), None if number(v) is not None else str(v), tags) for k, v in metrics.items()]
        df = self.spark.createDataFrame(rows, "name string, number double, text string, tags map<string,string>").withColumn("at", F.current_timestamp())
        df.coalesce(1).write.mode("append").parquet(self.path)


def alert_each(send: Callable[[dict], None], most: int = 100) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: send a message for each row, `most` of a batch at most, and one with the number of the others."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.limit(most + 1).collect()
        for r in rows[:most]:
            send(r.asDict(recursive=True))
        if len(rows) > most:
            send({"batch": batch_id, "more": batch.count() - most})

    return run


class Outbox:
    """For foreachBatch: sends each row of a stream once, whatever stops in between.

    A batch's messages are written first, each with an id of query, batch and row (equal rows are one message with `copies`);
    then they are sent in chunks, and a chunk's ids are written when it has been sent. A batch that comes again finds its
    messages written and goes on with those that aren't acknowledged. What was sent and not yet acknowledged when a driver
    died is a chunk at most: `known`, if given, asks the receiver which of its ids it has; other receivers must ignore an id
    that they have seen. All rows are sent; the driver holds a chunk at a time.

    With `tasks`, so many tasks send at once, in chunks of ascending ids, and nothing passes through the driver; `send` and
    `known` are pickled then. A task whose receiver fails ends there and the others go on; what was sent is acknowledged
    together at the end, then all failures are raised as one. A driver that dies before leaves up to a batch that was sent and not
    acknowledged, for which `known` or the receiver makes up as above.
    """

    MESSAGES = "message_id string, body string, copies long"
    SAID = "message_id string, attempt string, fresh boolean, error string"

    def __init__(self, spark: SparkSession, path: str, query: str, send: Callable[[list[dict]], None], known: Callable[[list[str]], set[str]] | None = None, chunk: int = 500, tasks: int | None = None):
        self.spark, self.path, self.query, self.send, self.known, self.chunk, self.tasks = spark, f"{path.rstrip('/')}/{query}", query, send, known, chunk, tasks

    def _pending(self, batch_id: int) -> DataFrame | None:
        there = f"{self.path}/pending/batch={batch_id}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{there}/_SUCCESS")
        return self.spark.read.schema(self.MESSAGES).parquet(there) if done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done) else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        again = self._pending(batch_id) is not None
        if not again:
            columns = batch.columns
            one = batch.groupBy(*columns).agg(F.count("*").alias("__copies"))
            key = F.sha2(F.concat_ws("|", F.lit(self.query), F.lit(str(batch_id)), row_hash(columns)), 256)
            one.select(key.alias("message_id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body"), F.col("__copies").alias("copies")).write.mode("overwrite").parquet(f"{self.path}/pending/batch={batch_id}")
        self.flush(batch_id, again)

    def flush(self, batch_id: int, again: bool = True) -> int:
        """Send what isn't acknowledged of a batch; the number of messages sent. `again`: some may have been sent before."""
        pending, acked = self._pending(batch_id), _maybe(self.spark, f"{self.path}/acknowledged/batch={batch_id}", "message_id string")
        if pending is None:
            return 0
        open_ = pending if acked is None else pending.join(acked, "message_id", "left_anti")
        if self.tasks:
            return self._flush_in_tasks(open_, batch_id, again)
        held, sent = [], 0

        def deliver() -> int:
            seen = self.known([m["message_id"] for m in held]) if again and self.known else set()
            fresh = [m for m in held if m["message_id"] not in seen]
            if fresh:
                self.send(fresh)
            self.spark.createDataFrame([(m["message_id"],) for m in held], "message_id string").coalesce(1).write.mode("append").parquet(f"{self.path}/acknowledged/batch={batch_id}")
            return len(fresh)

        for r in open_.toLocalIterator():
            held.append({"message_id": r["message_id"], "copies": r["copies"], "row": json.loads(r["body"])})
            if len(held) == self.chunk:
                sent, held = sent + deliver(), []
        return sent + (deliver() if held else 0)

    def _flush_in_tasks(self, open_: DataFrame, batch_id: int, again: bool) -> int:
        send, known, chunk, attempt = self.send, self.known, self.chunk, uuid.uuid4().hex

        def said(ids: list[str | None], fresh: list[bool], error: str | None = None) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([attempt] * n, pa.string()), pa.array(fresh, pa.bool_()), pa.array([error] * n, pa.string())], names=["message_id", "attempt", "fresh", "error"])

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
            held = []
            for batch in batches:
                for r in batch.to_pylist():
                    held.append({"message_id": r["message_id"], "copies": r["copies"], "row": json.loads(r["body"])})
                    if len(held) == chunk:
                        yield held
                        held = []
            if held:
                yield held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask = known is not None and (again or TaskContext.get().attemptNumber() > 0)
            for held in chunks(batches):
                ids = [m["message_id"] for m in held]
                try:
                    seen = known(ids) if ask else set()
                    fresh = [m for m in held if m["message_id"] not in seen]
                    if fresh:
                        send(fresh)
                except Exception as e:
                    yield said([None], [False], f"{type(e).__name__}: {e}")
                    for _ in batches:  # Spark expects that a task reads all that it is given
                        pass
                    return
                yield said(ids, [i not in seen for i in ids])

        path = f"{self.path}/acknowledged/batch={batch_id}"
        dealt = open_.select("message_id", "body", "copies").repartitionByRange(self.tasks, "message_id").sortWithinPartitions("message_id")
        dealt.mapInArrow(run, self.SAID).write.mode("append").parquet(path)
        result = self.spark.read.schema(self.SAID).parquet(path).where(F.col("attempt") == attempt).agg(F.count_if("fresh").alias("sent"), F.sort_array(F.collect_set("error")).alias("errors")).first()
        if result["errors"]:
            raise ConnectionError("; ".join(result["errors"]))
        return result["sent"]


class FolderReceiver:
    """Stands for a service that receives an outbox's messages: a chunk is a file of JSON lines, named by its least and largest
    id, so that only files whose ids may be among those asked for are read. For folders that all executors mount. With
    `breaks` it fails once, after a chunk was received."""

    BREAK = "after it was received, before it was acknowledged"

    def __init__(self, path: str, breaks: bool = False):
        self.path, self.breaks = path.removeprefix("file://"), breaks

    def send(self, messages: list[dict]) -> None:
        os.makedirs(self.path, exist_ok=True)
        ids = [m["message_id"] for m in messages]
        name = f"{min(ids)}-{max(ids)}-{uuid.uuid4().hex}.json"
        aside = os.path.join(self.path, f"_{name}")
        with open(aside, "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"message_id": m["message_id"], **m["row"]}) + "\n" for m in messages)
        os.replace(aside, os.path.join(self.path, name))
        if self.breaks:
            try:
                os.close(os.open(os.path.join(self.path, "_broken"), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return
            raise ConnectionError(self.BREAK)

    def known(self, ids: list[str]) -> set[str]:
        asked, low, high = set(ids), min(ids), max(ids)
        found = set()
        for name in os.listdir(self.path) if os.path.isdir(self.path) else []:
            first, _, rest = name.partition("-")
            if name.startswith("_") or first > high or rest.partition("-")[0] < low:
                continue
            with open(os.path.join(self.path, name), encoding="utf-8") as f:
                found |= asked & {json.loads(line)["message_id"] for line in f}
        return found


def add_pages(df: DataFrame, path: str, name: str, rows_a_page: int = 50_000) -> None:
    """Append rows to a folder log (see sources.pages) as JSON lines, a page for each partition's every `rows_a_page` rows, under
    names that sort behind those of smaller `name`. Who reads a page holds it whole, so a page doesn't grow with its table."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}/_{name}"
    df.write.option("maxRecordsPerFile", rows_a_page).json(aside)
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(aside)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in fs.listStatus(folder):
        old = file.getPath()
        if old.getName().startswith("part-"):
            fs.rename(old, jvm.Path(f"{path.rstrip('/')}/{name}-{old.getName()}"))
    fs.delete(folder, True)
