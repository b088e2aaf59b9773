"""Overlaps whose right side is joined by blocks of neighbours in time."""

import os
import random

import pytest

import __spark_entry__
from siltstone.operators import intervals


def test_pairs_written_are_small(spark, tmp_path):
    """Pairs come block by block, so that Parquet finds a block's rows repeated for each row that meets them."""
    left = spark.range(640).selectExpr("id * 1000003 AS i", "timestamp_millis(id) AS s", "timestamp_millis(id + 7200000) AS e")
    right = spark.range(12_000).selectExpr("id * 7919 AS j", "timestamp_millis(id * 100) AS s2", "timestamp_millis(id * 100 + 3600000) AS e2")
    path = f"{tmp_path}/pairs"
    intervals.overlap_join(left, right, ("s", "e"), ("s2", "e2"), block=128).select("i", "j").write.parquet(path)
    rows = spark.read.parquet(path)
    assert rows.distinct().count() == rows.count() == 640 * 12_000
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    assert size < 0.4 * 640 * 12_000, size


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_lose_no_pair(spark, block):
    rng = random.Random(block)
    some = lambda n: [(i, rng.choice([0, 0, 0, None]), s := rng.randint(-5000, 5000), rng.choice([None, s, s + 1, s + 40, s + 3000])) for i in range(n)]
    a, b = some(120), some(90)
    left = spark.createDataFrame(a, "i long, k long, s long, e long").selectExpr("i", "k", "timestamp_seconds(s) s", "timestamp_seconds(e) e")
    right = spark.createDataFrame(b, "j long, k long, s2 long, e2 long").selectExpr("j", "k", "timestamp_seconds(s2) s2", "timestamp_seconds(e2) e2")
    end = lambda x: 10**12 if x[3] is None else x[3]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] is not None and x[2] < end(y) and y[2] < end(x))
    found = intervals.overlap_join(left, right, ("s", "e"), ("s2", "e2"), ["k"], block=block)
    assert found.columns == ["k", "i", "s", "e", "j", "s2", "e2"] and sorted((r.i, r.j) for r in found.collect()) == want


def test_events_in_windows_goes_by_blocks(spark):
    found = __spark_entry__.queries()["events_in_windows"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate inline(") == 2
