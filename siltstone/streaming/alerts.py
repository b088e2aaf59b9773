"""Alerts of policies on running queries: state across micro-batches, timers in event time, each alert once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ALERTS = "query_id string, started timestamp, deadline timestamp, reason string"


#: A time that a row doesn't say.
_NONE = -(2**63)


class _Overdue(StatefulProcessor):
    """State of a group of queries, a table in Arrow's form: when each started and ended (microseconds, -1: not known), its
    limit, whether it was reported, and when (milliseconds) it is looked at next. So a micro-batch costs a read and a write of
    state for each group that has rows, not several for each query. A group has one timer, not later than its first query's."""

    NAMES = ("query_id", "started", "ended", "allowed", "told", "due")

    def __init__(self, keep_seconds: float):
        self.keep = int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queries", "queries binary")

    def _read(self) -> list[np.ndarray]:
        got = self.state.get() if self.state.exists() else None
        if got is None:
            return [np.array([], object), *(np.array([], np.int64) for _ in range(3)), np.array([], bool), np.array([], np.int64)]
        return [np.array(c.to_numpy(zero_copy_only=False)) for c in pa.ipc.open_stream(bytes(got[0])).read_all().combine_chunks().columns]

    def _write(self, columns: list[np.ndarray], keep: np.ndarray | slice, now: int) -> None:
        columns = [c[keep] for c in columns]
        timers = list(self.handle.listTimers())
        if not len(columns[0]):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.state.clear()
            return
        batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c) for c in columns[1:])], names=list(self.NAMES))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        self.state.update((sink.getvalue().to_pybytes(),))
        first = max(now + 1, int(columns[5].min()))
        if not timers or min(timers) > first:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held, new = timerValues.getCurrentWatermarkInMs(), self._read(), pd.concat(list(rows))
        codes, ids = pd.factorize(np.concatenate([held[0], new["query_id"].to_numpy(object)]), use_na_sentinel=False)
        known, codes = len(held[0]), codes[len(held[0]) :]
        more = len(ids) - known
        columns = [np.asarray(ids, object), *(np.concatenate([c, np.full(more, -1)]) for c in held[1:4]), np.concatenate([held[4], np.zeros(more, bool)]), np.concatenate([held[5], np.zeros(more, np.int64)])]
        _, started, ended, allowed, told, due = columns
        for column, name in ((started, "started_us"), (ended, "ended_us"), (allowed, "allowed_us")):
            said = new[name].to_numpy(np.int64)
            column[codes[said != _NONE]] = said[said != _NONE]  # of several rows the last one counts
        touched = np.unique(codes)
        s, e, limit = started[touched], ended[touched], started[touched] + allowed[touched]
        late = ~told[touched] & (s >= 0) & (e >= 0) & (e > limit)
        open_ = (s >= 0) & (e < 0) & ~told[touched]
        told[touched] |= late
        # event time stands at the watermark; a deadline before it is told at once
        due[touched] = np.where(open_, np.maximum(now + 1, -(-limit // 1000)), np.maximum(now, np.maximum(s, e) // 1000) + self.keep)
        self._write(columns, slice(None), now)
        if late.any():
            yield self._alerts(columns, touched[late], "ENDED_LATE")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, columns = timerValues.getCurrentWatermarkInMs(), self._read()
        _, started, ended, _, told, due = columns
        over = due < max(now, expiredTimerInfo.getExpiryTimeInMs() + 1)  # rows of the watermark itself may still come
        still = over & (started >= 0) & (ended < 0) & ~told
        told[still] = True
        due[still] += self.keep
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        self._write(columns, ~over | still, now)
        if still.any():
            yield self._alerts(columns, np.flatnonzero(still), "STILL_RUNNING")

    @staticmethod
    def _alerts(columns: list[np.ndarray], at: np.ndarray, reason: str) -> pd.DataFrame:
        time = lambda us: pd.to_datetime(us, unit="us", utc=True)
        return pd.DataFrame({"query_id": columns[0][at], "started": time(columns[1][at]), "deadline": time(columns[1][at] + columns[3][at]), "reason": reason})

    def close(self) -> None:
        pass


def overdue_alerts(events: DataFrame, late: str = "10 minutes", keep_seconds: float = 7 * 86_400, groups: int = 2048) -> DataFrame:
    """A stream of query_id, started, deadline, reason: each query that ran longer than it may, once.

    events is a stream of query_id, at (timestamp), status (RUNNING or any other: ended) and seconds (what a query may take; of
    RUNNING rows). A query that is still running is told when the watermark passes its deadline; one whose end comes first, and
    is too late, when that is read. Rows may come in any order within `late`, and again. What is known of a query is forgotten
    `keep_seconds` after its last event, so state is bounded by the queries of that time. State is held by `groups` of queries, of which
    there should be more than tasks; a checkpoint is read with the number that it was written with. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass); state and timers are in the checkpoint, so a restart tells none twice.
    """
    us = lambda c: F.unix_micros(F.col(c))
    running = F.col("status") == "RUNNING"
    given = lambda when, value: F.coalesce(F.when(when, value), F.lit(_NONE))
    name = F.col("query_id").cast("string")
    rows = events.withWatermark("at", late).select(
        F.pmod(F.xxhash64(name), F.lit(groups)).alias("group"), name.alias("query_id"), "at", given(running, us("at")).alias("started_us"), given(~running, us("at")).alias("ended_us"), given(running, (F.col("seconds") * 1_000_000).cast("long")).alias("allowed_us")
    )
    return rows.groupBy("group").transformWithStateInPandas(_Overdue(keep_seconds), ALERTS, "append", "EventTime")
