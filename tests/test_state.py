"""Sketches, levels, layout measures, partitioned merges, paged sources, stateful alerts and outboxes."""

import glob
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import intervals, layout, merge, sketches
from siltstone.operators.partitions import PartitionedTable
from siltstone.session import ROCKSDB
from siltstone.sources.pages import PagedSource
from siltstone.streaming import alerts
from siltstone.streaming.sinks import Outbox
from siltstone.streaming.streams import drain

DAY = datetime(2024, 1, 1)


def test_sketches_merge_over_hours(spark):
    df = spark.range(50_000).select((F.lit(DAY) + F.make_dt_interval(hours=(F.col("id") % 48).cast("int"))).alias("ts"), (F.col("id") % 2).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 1000).cast("double").alias("v"), (F.col("id") % 700).alias("u"))
    hours = sketches.hourly(df, "ts", ["k"], ["v"], ["u"])
    assert hours.count() == 48
    got = {r.k: r for r in sketches.merged(hours, ["k"]).select("k", "rows", sketches.quantile("v", 0.5).alias("p50"), sketches.distinct("u").alias("u")).collect()}
    assert all(got[k].rows == 25_000 and abs(got[k].p50 - 500) < 30 and abs(got[k].u - 350) <= 20 for k in (0, 1))
    none = sketches.merged(sketches.hourly(df.where("v is null"), "ts", [], ["v"], [])).select(sketches.quantile("v", 0.5)).first()
    assert none[0] is None
    assert sketches.merged(sketches.hourly(df.limit(0), "ts", ["k"], ["v"], ["u"]), ["k"]).collect() == []


@pytest.mark.parametrize("slice_seconds", [1, 3600, 86_400])
def test_step_levels(spark, slice_seconds):
    """Second stops and starts without a stop before them say nothing new; slices don't change the result."""
    at = lambda h: DAY + timedelta(hours=h)
    rows = [("a", at(0), 1), ("a", at(2), 3), ("a", at(2), 2), ("a", at(30), 3), ("a", at(40), 0), ("a", at(41), 0), ("a", at(60), 1), ("a", at(61), None), ("b", at(5), 2), (None, at(5), 1), (None, at(6), 1), ("c", None, 4)]
    steps = intervals.step_levels(spark.createDataFrame(rows, "w string, t timestamp, n int"), ["w"], "t", "n", slice_seconds)
    got = sorted(map(tuple, steps.collect()), key=str)
    assert got == sorted([("a", 1, at(0), at(2)), ("a", 3, at(2), at(40)), ("a", 0, at(40), at(60)), ("a", 1, at(60), None), ("b", 2, at(5), None), (None, 1, at(5), None)], key=str)
    mean = {(r.w, r.bucket.day): (round(r.seconds / 3600, 6), round(r.mean_level, 6)) for r in intervals.time_weighted(steps, ["w"], F.lit(at(72))).collect()}
    assert mean["a", 1] == (24, round((2 + 22 * 3) / 24, 6)) and mean["a", 2] == (24, 2.0) and mean["a", 3] == (24, 0.5) and mean["b", 3] == (24, 2.0)


def test_layout_depth_and_files_read(spark, tmp_path):
    ranges = spark.createDataFrame([("f1", 1, 5), ("f2", 3, 8), ("f3", 8, 9), ("f4", None, None)], "file_path string, min_v int, max_v int")
    assert tuple(layout.overlap_depth(ranges, ["v"]).first()) == ("v", 3, pytest.approx((1 + 2 + 2 + 2 + 2 + 1) / 6, abs=1e-6), 2)
    asked = spark.createDataFrame([(4, 4), (8, 8), (10, 20), (4, 4)], "low int, high int")
    assert sorted(map(tuple, layout.files_read(ranges, "v", asked).collect())) == [(4, 4, 2, 4), (4, 4, 2, 4), (8, 8, 2, 4), (10, 20, 0, 4)]
    df = spark.range(20_000).select((F.xxhash64("id") % 1000).alias("v"))
    df.repartition(8).write.parquet(f"{tmp_path}/a")
    layout.clustered(df, ["v"], files=8).write.parquet(f"{tmp_path}/b")
    a, b = (layout.overlap_depth(layout.file_ranges(spark, f"{tmp_path}/{x}", ["v"]), ["v"]).first() for x in "ab")
    assert a.mean_depth > 5 and a.max_depth == 8 and b.mean_depth < 1.5 and a.files == 8


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_merges_rewrite_touched_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = PartitionedTable(spark, path, ["p"])
    table.create(spark.range(1000).select("id", (F.col("id") % 20).cast("int").alias("p"), F.lit("old").alias("v")).repartition(3))
    before = _files(path)
    changes = spark.createDataFrame([(3, 3, "new"), (4, 4, "new"), (5000, 4, "add"), (9000, 30, "add")], "id long, p int, v string")
    assert table.merge(changes, lambda now, new: merge.upsert(now, new, ["id"])) == 3
    after = _files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f for f in before if "/p=3/" not in f and "/p=4/" not in f} == same
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == 1002 and got[3] == got[4] == "new" and got[5000] == got[9000] == "add" and got[23] == "old"
    # a partition that is left without rows goes; nothing else does
    assert table.merge(spark.createDataFrame([(i, 7, "x") for i in range(7, 1000, 20)], "id long, p int, v string"), lambda now, new: merge.delete_matching(now, new, ["id"])) == 1
    assert table.read().where("p = 7").count() == 0 and table.read().count() == 952 and not os.path.exists(f"{path}/p=7")
    assert table.merge(changes.limit(0), lambda now, new: now) == 0
    with pytest.raises(ValueError):
        table.merge(changes, lambda now, new: now, most=2)


def test_a_merge_that_stops_is_finished_by_the_next_reader(spark, tmp_path, monkeypatch):
    table = PartitionedTable(spark, f"{tmp_path}/t", ["p"])
    table.create(spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("p"), F.lit("old").alias("v")))
    changes = spark.createDataFrame([(1, 1, "new")], "id long, p int, v string")
    work = lambda now, new: merge.upsert(now, new, ["id"])

    def broken(self, aside):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(PartitionedTable, "_replace", broken)
        with pytest.raises(RuntimeError):
            table.merge(changes, work)
    again = PartitionedTable(spark, f"{tmp_path}/t", ["p"])
    rows = again.read()
    assert rows.count() == 100 and rows.where("v = 'new'").count() == 1 and not again.recover()


class Chained:
    """A service that can't list its pages."""

    def __init__(self, options):
        self.pages = int(options["pages"])

    def fetch(self, token):
        at = int(token or 0)
        return ([{"id": at, "name": f"n{at}"}], str(at + 1)) if at < self.pages else ([], None)


def _pages(reader, **options):
    reader = reader.format("pages").option("schema", "id long, name string")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    os.makedirs(f"{tmp_path}/log")
    add = lambda name, rows: open(f"{tmp_path}/log/{name}.json", "w").write("\n".join(map(json.dumps, rows)))
    folder = {"service": "siltstone.sources.pages:FolderLog", "path": f"{tmp_path}/log"}
    assert _pages(spark.read, **folder).count() == 0
    add("a", [{"id": 1, "name": "x"}, {"id": 2}])
    add("b", [{"id": 3, "name": "y", "more": 1}])
    batch = _pages(spark.read, **folder)
    assert sorted(map(tuple, batch.collect())) == [(1, "x"), (2, None), (3, "y")] and batch.rdd.getNumPartitions() == 2
    for name in ("c", "d"):
        drain(_pages(spark.readStream, **folder), f"{tmp_path}/ck", f"{tmp_path}/out")
        add(name, [{"id": ord(name), "name": name}])
    drain(_pages(spark.readStream, **folder), f"{tmp_path}/ck", f"{tmp_path}/out")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 99, 100]
    chained = {"service": "tests.test_state:Chained", "pages": 5}
    assert sorted(r.id for r in _pages(spark.read, **chained).collect()) == [0, 1, 2, 3, 4]
    for _ in range(3):
        drain(_pages(spark.readStream, **chained), f"{tmp_path}/ck2", f"{tmp_path}/out2")
    got = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out2").collect())
    assert got == list(range(len(got))) and got


def test_overdue_alerts_fire_once(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    schema = "query_id string, at timestamp, status string, seconds double"
    batches = [
        [("slow", at(0), "RUNNING", 600.0), ("quick", at(0), "RUNNING", 600.0), ("quick", at(5), "FINISHED", None), ("early end", at(6), "FINISHED", None), ("early end", at(4), "RUNNING", 600.0)],
        [("slow", at(0), "RUNNING", 600.0), ("late end", at(7), "RUNNING", 60.0), ("late end", at(9), "FINISHED", None), ("edge", at(8), "RUNNING", 60.0), ("edge", at(9), "FINISHED", None)],
        [("tick", at(60), "RUNNING", 36000.0)],
        [("slow", at(61), "FINISHED", None), ("tick2", at(90), "RUNNING", 36000.0)],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for rows in batches:  # the stream stops and starts from its checkpoint each time
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
            drain(alerts.overdue_alerts(stream), f"{tmp_path}/c", f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = sorted((r.query_id, r.deadline, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert told == [("late end", at(8), "ENDED_LATE"), ("slow", at(10), "STILL_RUNNING")]


def test_outbox_sends_each_row_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, None if i == 3 else f"x{i % 7}") for i in range(10)], "id long, name string")
    got, fail = [], {"at": None}

    def send(messages):
        if fail["at"] == "before":
            fail["at"] = None
            raise ConnectionError
        got.extend(messages)
        if fail["at"] == "after":
            fail["at"] = None
            raise ConnectionError

    box = Outbox(spark, str(tmp_path), "q", send, lambda ids: {m["message_id"] for m in got} & set(ids), chunk=3)
    for batch, at in enumerate((None, "before", "after")):
        fail["at"] = at
        if at:
            with pytest.raises(ConnectionError):
                box(rows, batch)
        box(rows, batch)
        box(rows, batch)  # a batch that comes again
    assert len({m["message_id"] for m in got}) == len(got) == 3 * 7  # ids 0 to 6, three of them twice
    assert sum(m["copies"] for m in got) == 30 and {"id": 3, "name": None} in [m["row"] for m in got]
    assert box.flush(0) == 0 and box.flush(99) == 0
