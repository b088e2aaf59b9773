"""Failures of an outbox's receiver beside the one that is planned."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltstone.streaming import sinks


@pytest.fixture
def events(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value"), F.lit("error").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_failure_after_the_break_is_an_error(spark, events, monkeypatch):
    class Full(sinks.FolderReceiver):
        def send(self, messages):
            if os.path.exists(os.path.join(self.path, "_broken")):
                raise OSError("no space left")
            sinks.FolderReceiver.send(self, messages)

    monkeypatch.setattr(sinks, "FolderReceiver", Full)
    with pytest.raises(Exception, match="no space left"):
        __spark_entry__.queries()["outbox_alerts"](spark, events).collect()


def test_a_break_alone_leaves_the_result_whole(spark, events):
    rows = __spark_entry__.queries()["outbox_alerts"](spark, events).collect()
    assert sorted((r.event_id, r.times) for r in rows) == [(i, 1) for i in range(300)]


def test_no_failure_is_hidden_by_another(spark, tmp_path):
    def send(messages):
        raise OSError("disk") if min(m["row"]["id"] for m in messages) < 50 else ConnectionError("line")

    with pytest.raises(ConnectionError, match="ConnectionError: line; OSError: disk"):
        sinks.Outbox(spark, str(tmp_path), "q", send, chunk=1, tasks=4)(spark.range(100), 0)
