"""Runs that stop between two writes, and merges whose source repeats a key."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from siltstone.operators import merge
from siltstone.sources import files

NAMES = "task_id int, src_path string, src_format string, src_column_list string, src_sep string, src_header boolean, bronze_table string, silver_table string, primary_key string"


class Killed(Exception):
    pass


def stop_at(monkeypatch, number):
    """The write with this number doesn't happen."""
    written, parquet = [], DataFrameWriter.parquet

    def write(self, *a, **b):
        written.append(a)
        if len(written) == number:
            raise Killed
        return parquet(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)


def test_a_load_that_stops_counts_for_nothing(spark, tmp_path, monkeypatch):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").csv(f"{tmp_path}/in")
    load = lambda: files.copy_into(spark, f"{tmp_path}/in", f"{tmp_path}/t", "csv", schema="id long", glob="*.csv", portion=2)
    for number in (1, 2, 3, 4):
        with monkeypatch.context() as m:
            stop_at(m, number)
            try:
                load()
            except Killed:
                pass
    load()
    assert load() == 0
    assert sorted(r.id for r in files.loaded(spark, f"{tmp_path}/t").collect()) == list(range(30))


@pytest.mark.parametrize("number", [1, 2, 3, 4])
def test_ingest_goes_on_after_any_write(spark, tmp_path, monkeypatch, number):
    root, target = f"{tmp_path}/raw", f"{tmp_path}/t"
    add = lambda rows: spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").option("sep", ";").csv(f"{root}/x")
    tasks = spark.createDataFrame([(1, "x", "csv", "k int, v string", ";", False, "b", "s", "k")], NAMES)
    add([(1, "a"), (2, "b")])
    files.ingest_tasks(spark, tasks, root, target)
    add([(2, "bb"), (3, "c")])
    with monkeypatch.context() as m:
        stop_at(m, number)
        with pytest.raises(Killed):
            files.ingest_tasks(spark, tasks, root, target)
    said = files.ingest_tasks(spark, tasks, root, target)[0]
    assert sorted((r.k, r.v) for r in spark.read.parquet(said["silver"]).collect()) == [(1, "a"), (2, "bb"), (3, "c")]
    assert sorted(r.v for r in files.loaded(spark, f"{target}/b").collect()) == ["a", "b", "bb", "c"]
    assert files.ingest_tasks(spark, tasks, root, target)[0]["files"] == 0


def test_repeated_source_keys_are_an_error(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (None, "p"), (None, "q")], "id int, v string")
    for work in (lambda s: merge.upsert(target, s, ["id"]), lambda s: merge.update_columns(target, s, ["id"], ["v"])):
        with pytest.raises(Exception, match="several source rows"):
            work(twice).collect()
    assert merge.upsert(target, twice.where("id is null"), ["id"]).count() == 4
    assert merge.update_columns(target, twice.where(F.col("v") != "y"), ["id"], ["v"]).where("id = 1").first().v == "x"
