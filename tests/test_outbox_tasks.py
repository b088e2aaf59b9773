"""An outbox whose tasks send."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone.streaming.sinks import FolderReceiver, Outbox


def test_tasks_send_each_row_once(spark, tmp_path):
    receiver = FolderReceiver(f"{tmp_path}/got", breaks=True)
    box = Outbox(spark, str(tmp_path), "q", receiver.send, receiver.known, chunk=7, tasks=3)
    rows = spark.range(100).select("id", F.when(F.col("id") != 3, F.lit("x")).alias("name"))
    rows = rows.unionByName(rows.where("id < 10"))
    with pytest.raises(ConnectionError):
        box(rows, 0)
    assert len(os.listdir(f"{tmp_path}/got")) > 1  # the other tasks went on
    for _ in range(2):
        box(rows, 0)
    box(rows, 1)
    got = [json.loads(x) for name in os.listdir(f"{tmp_path}/got") if name.endswith(".json") for x in open(f"{tmp_path}/got/{name}")]
    assert len({m["message_id"] for m in got}) == len(got) == 200 and sorted(m["id"] for m in got) == sorted(2 * list(range(100)))
    assert {m["name"] for m in got if m["id"] == 3} == {None} and box.flush(0) == 0 and box.flush(99) == 0
    # none is acknowledged that wasn't sent
    assert spark.read.parquet(f"{tmp_path}/q/acknowledged/batch=0").where("message_id IS NOT NULL").select("message_id").distinct().count() == 100
