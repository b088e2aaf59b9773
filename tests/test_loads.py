"""Loads, scripts, feeds, policies and sweeps."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from siltstone import session
from siltstone.functions import expressions as fx
from siltstone.operators import costs, graph, intervals, layout, merge
from siltstone.sources import catalog, files, paged
from siltstone.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_change_feed_of_null_keys(spark):
    before = spark.createDataFrame([(None, 1), (1, 1), (2, 1), (5, None)], "k int, v int")
    after = spark.createDataFrame([(None, 1), (1, 2), (3, 1), (5, None)], "k int, v int")
    changes = merge.changes_between(before, after, ["k"])
    assert rows(changes) == [(1, 1, "update_preimage"), (1, 2, "update_postimage"), (2, 1, "delete"), (3, 1, "insert")]
    assert rows(merge.replay(before, changes.withColumn("_commit_version", F.lit(1)), ["k"])) == rows(after)
    gone = merge.changes_between(after, after.where("k IS NOT NULL"), ["k"])
    assert rows(gone) == [(None, 1, "delete")] and rows(merge.replay(after, gone.withColumn("_commit_version", F.lit(2)), ["k"])) == rows(after.where("k IS NOT NULL"))


def test_update_and_delete_leave_unknown_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert rows(merge.updated(t, {"k": F.lit(9)}, F.col("v") == "a")) == [(2, None), (3, "c"), (9, "a")]
    assert rows(merge.deleted(t, F.col("v") == "a")) == [(2, None), (3, "c")]


def test_refresh(spark):
    source = spark.createDataFrame([(1, 5), (1, 7), (2, 6)], "k int, at int")
    first, how = merge.refreshed(None, source.where("at < 7"), ["k"], "at")
    assert how == "full" and rows(first) == [(1, 5), (2, 6)]
    assert [rows(x) if not isinstance(x, str) else x for x in merge.refreshed(first, source, ["k"], "at")] == [[(1, 7), (2, 6)], "incremental"]
    assert merge.refreshed(first, source, ["k"], "at", full=True)[1] == "full"
    assert rows(merge.incremental_merge(first.limit(0), source, ["k"], "at")) == [(1, 7), (2, 6)]


def test_merge_feed_reads_what_is_new(spark):
    feed = spark.createDataFrame([(1, 10, "insert", 1), (2, 10, "insert", 1), (1, 20, "delete", 2), (2, 5, "update_postimage", 3)], "k int, at int, _change_type string, _commit_version long")
    empty = feed.limit(0).select("k", "at", F.col("_commit_version").alias("_src_commit_version"))
    once = merge.merge_feed(empty, feed.where("_commit_version = 1"), ["k"], "at")
    assert rows(once) == [(1, 10, 1), (2, 10, 1)]
    assert rows(merge.merge_feed(once, feed, ["k"], "at")) == [(2, 10, 1)]  # a delete, and a change that comes too late
    plan = merge.merge_feed(once, feed, ["k"], "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "> 1" in plan  # a literal, not a join


def test_rows_of_one_load_stay_in_many_tasks(spark, tmp_path):
    """All rows of a load have one load_id; they must not meet in the task that holds it."""
    spark.range(0, 400, 1, 4).write.parquet(f"{tmp_path}/raw")
    assert files.copy_into(spark, f"{tmp_path}/raw", f"{tmp_path}/t", "parquet") == 4
    ids = [(r[0],) for r in spark.read.parquet(f"{tmp_path}/t/_loaded").select("load_id").distinct().collect()]
    rows = files.loaded(spark, f"{tmp_path}/t", spark.createDataFrame(ids, "load_id string"))
    assert len(ids) == 1 and sorted(r.id for r in rows.collect()) == list(range(400))
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_ingest_tasks_merge_new_files(spark, tmp_path):
    root, target = str(tmp_path / "raw"), str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.option("sep", ";").option("header", "true").csv(f"{root}/x")
    names = "task_id int, src_path string, src_format string, src_column_list string, src_sep string, src_header boolean, bronze_table string, silver_table string, primary_key string"
    tasks = spark.createDataFrame([(1, "x", "csv", "k int, v string", ";", True, "b", "s", "k")], names)
    assert files.ingest_tasks(spark, tasks, root, target)[0]["files"] > 0
    spark.createDataFrame([(2, "bb"), (3, "c")], "k int, v string").coalesce(1).write.mode("append").option("sep", ";").option("header", "true").csv(f"{root}/x")
    said = files.ingest_tasks(spark, tasks, root, target)[0]
    assert rows(spark.read.parquet(said["silver"]).select("k", "v")) == [(1, "a"), (2, "bb"), (3, "c")]
    assert files.ingest_tasks(spark, tasks, root, target)[0]["files"] == 0


def test_script_graph_stops_behind_failures(spark):
    scripts = {"a": "SELECT 1", "b": "SELECT no_such_column", "c": "SELECT 2; SELECT 3", "d": "SELECT 4"}
    out = paged.run_graph(spark, scripts, {"c": ["a"], "d": ["b", "a"]})
    assert set(out) == {"a", "b", "c"} and out["b"][-1]["status"] == "FAILED" and len(out["c"]) == 2
    with pytest.raises(ValueError, match="cycle"):
        paged.run_graph(spark, scripts, {"a": ["c"], "c": ["a"]})


def test_statements_of_comments():
    assert fx.statements("-- only words; here\n/* and; here */;;") == []
    assert fx.statements("SELECT ';' -- a; b\n; /* x */ SELECT 2") == ["SELECT ';' -- a; b", "/* x */ SELECT 2"]


def test_benchmark(spark):
    def fails():
        raise RuntimeError("no")

    runs = paged.measured(spark, {"a": lambda: spark.range(5), "b": fails}, repetitions=2, at_once=2)
    got = {r["query"]: r for r in paged.benchmark_rates(runs).collect()}
    assert (got["a"].runs, got["a"].failures, got["b"].failures) == (2, 0, 2) and got["a"].a_minute > 0


def test_policies_are_checked(spark):
    good = spark.createDataFrame([(["a", "b"], 30, "ALL")], "warehouse_ids array<string>, sla_seconds int, policy_mode string")
    import hashlib

    assert intervals.checked_policies(good).first().policy_hash == hashlib.sha256(b"a,b30ALL").hexdigest()
    for bad in (["a"], 30, "SOMETIMES"), (None, 30, "ALL"), (["a"], None, "ALL"):
        with pytest.raises(Exception, match="a policy needs"):
            intervals.checked_policies(spark.createDataFrame([bad], good.schema)).collect()


@pytest.mark.parametrize("seconds", [1, 7, 10**6])
def test_sweep_by_slices(spark, seconds):
    """The same levels whatever the slice; some slices hold no event at all."""
    rng = random.Random(seconds)
    start = dt.datetime(2024, 1, 1)
    spans = []
    for _ in range(60):
        a = rng.choice([0, 5, 300]) + rng.randrange(30)
        spans.append((rng.choice(["x", "y", None]), start + dt.timedelta(seconds=a), start + dt.timedelta(seconds=a + rng.randrange(0, 40))))
    df = spark.createDataFrame(spans, "k string, s timestamp, e timestamp")
    low, high = start + dt.timedelta(seconds=2), start + dt.timedelta(seconds=400)
    want = {}
    for key in {s[0] for s in spans}:
        marks = sorted({low, high, *(t for k, a, b in spans if k == key for t in (a, b) if low < t < high)})
        for p, q in zip(marks, marks[1:]):
            level = sum(a <= p and b >= q and b > a for k, a, b in spans if k == key)
            want[key, level] = want.get((key, level), 0) + (q - p).total_seconds()
    got = intervals.concurrency_levels(df, "s", "e", F.lit(low), F.lit(high), ["k"], slice_seconds=seconds)
    assert {(r.k, r.level): round(r.seconds, 6) for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_pareto_counts_peers_together(spark):
    data = [("a", 5.0), ("b", 3.0), ("b", 3.0), ("c", 1.0)]
    got = [(r.n, round(r.cumulative, 4), r.vital) for r in costs.pareto(spark.createDataFrame(data, "n string, v double"), "v", "n").collect()]
    assert sorted(got) == [("a", round(5 / 12, 4), True), ("b", round(11 / 12, 4), True), ("b", round(11 / 12, 4), True), ("c", 1.0, False)]


def test_pagerank_on_a_cycle(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, type string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    got = {r.id: r.score for r in graph.pagerank(nodes, edges, rounds=12).collect()}
    w, out = dict.fromkeys("abc", 1 / 3), {"a": ["b", "c"], "b": ["c"], "c": ["a"]}
    for _ in range(12):
        w = {n: sum(0.85 * w[s] / len(ts) for s, ts in out.items() if n in ts) for n in "abc"}
    assert all(abs(got[n] - w[n] - 0.05 * (1 - 0.85**12) / 0.15) < 1e-9 for n in "abc")
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = {r.id: r.score for r in graph.pagerank(nodes, chain).collect()}
    assert abs(got["c"] - 0.85**2 / 3 - 0.05 * (1 - 0.85**2) / 0.15) < 1e-12 and got["a"] == got["b"]


def test_file_sizes_and_samples(spark):
    size = F.col("id") * F.lit(layout.GB)
    got = {r.id: r.mb for r in spark.createDataFrame([(x,) for x in (0, 8, 9, 64, 65, 2561, 3073, 819_200, 819_201, 1_638_401)], "id long").select("id", layout.file_size_mb(size).alias("mb")).collect()}
    assert got == {0: 16, 8: 16, 9: 32, 64: 64, 65: 128, 2561: 716, 3073: 1024, 819_200: 1024, 819_201: 2048, 1_638_401: None}
    a, b = (rows(layout.sample_rows(spark.range(500).repartition(n), 20, "id", 3)) for n in (2, 9))
    assert a == b and len(a) == 20 and a != rows(layout.sample_rows(spark.range(500), 20, "id", 4))


def test_budgets_and_discounts(spark):
    usage = spark.createDataFrame([("JOBS_X", dt.datetime(2024, 1, 1, 5, 10), 10.0), ("JOBS_X", dt.datetime(2024, 1, 1, 5, 50), 5.0), ("SQL", dt.datetime(2024, 1, 1, 5), 1.0), ("NEW", dt.datetime(2024, 1, 1, 5), 1.0)], "sku_name string, usage_start_time timestamp, usage_quantity double")
    prices = spark.createDataFrame([("JOBS_X", 1.0, 1), ("JOBS_X", 2.0, 2), ("SQL", 7.0, 1)], "sku_name string, price double, price_start_time int")
    priced = costs.priced(usage, prices, discounts={"jobs": 0.5})
    budgets = spark.createDataFrame([("JOBS_X", 14.0), ("SQL", 7.0)], "sku_name string, hourly_budget double")
    got = {r.sku_name: (r.cost, r.over_budget) for r in costs.against_budget(priced, budgets, "sku_name").collect()}
    assert got == {"JOBS_X": (15.0, True), "SQL": (7.0, False), "NEW": (0.0, False)}


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS `select`")
    spark.range(3).write.mode("overwrite").saveAsTable("`select`.`from`")
    found = catalog.catalog_tables(spark, include={"schema_name": ["select"]}, exclude={"table_name": ["other"]})
    assert [r.table_name for r in found.collect()] == ["from"]
    assert catalog.describe(spark, "`select`.`from`")["Type"] == "MANAGED"
    assert rows(catalog.table_profile(spark, ["`select`.`from`"]).select("type", "provider")) == [("MANAGED", "parquet")]
    spark.sql("DROP DATABASE `select` CASCADE")


def test_read_files_and_bloom_filters(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(50)], "id int, name string")
    files.with_bloom_filters(df.coalesce(1).write, {"name": 50}).parquet(str(tmp_path / "a"))
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(glob.glob(f"{tmp_path}/a/*.parquet")[0]).metadata.row_group(0)
    assert meta.num_columns == 2
    df.coalesce(1).write.json(str(tmp_path / "j"))
    (tmp_path / "j" / "broken.json").write_text("{")
    read = files.read_files(spark, str(tmp_path / "j"), "json", "id int, name string", glob="part-*.json", file_name=True, ignoreCorruptFiles=True)
    assert read.count() == 50 and read.select("file_path").distinct().count() == 1
    assert files.read_files(spark, str(tmp_path / "j"), "json", "id int, name string", stream=True, glob="part-*.json").isStreaming


def test_progress_of_streams(spark, tmp_path):
    log = streams.ProgressLog()
    spark.streams.addListener(log)
    try:
        spark.range(20).write.parquet(str(tmp_path / "in"))
        streams.drain(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "out"))
        import time

        for _ in range(50):
            if log.rows:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert sum(r["input_rows"] for r in log.rows) == 20
    rates = streams.progress_rates(spark.createDataFrame(log.rows, "id string, run_id string, name string, batch_id long, at string, input_rows long, rows_a_second double, trigger_ms long"))
    assert rates.first().input_rows == 20


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def __init__(self, **x):
            self.x = x

        def get(self, key, default=None):
            return self.x.get(key, default)

        def set(self, key, value):
            self.x[key] = value

    class Spark:
        def __init__(self, master, **x):
            self.conf = Conf(**{"spark.master": master, **x})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Spark("local-cluster[2,1,1024]"))
    assert session.shared_folder(Spark("yarn", **{"spark.checkpoint.dir": "hdfs://x/"})) == "hdfs://x"
    assert session.shared_folder(Spark("local[2]")).startswith("file:///")


def test_layout_commands_run_by_table(spark):
    said = []

    class Runner:
        def sql(self, text):
            said.append(text)
            if "bad" in text:
                raise RuntimeError("no")

    tables = spark.createDataFrame([("a", "OPTIMIZE a", None, "ANALYZE a"), ("b", "OPTIMIZE bad", "ALTER b", "ANALYZE b")], "table_name string, optimize string, properties string, analyze string")
    out = [(x["table_name"], x["statement"], x["status"]) for x in layout.run_commands(Runner(), tables)]
    assert out == [("a", "OPTIMIZE a", "SUCCEEDED"), ("a", "ANALYZE a", "SUCCEEDED"), ("b", "OPTIMIZE bad", "FAILED")] and "ALTER b" not in said


def test_scaling_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 2.0), (None, 4.0)], "g string, v double")
    assert rows(layout.min_max_scaled(df, ["v"], ["g"])) == [("a", 1.0, 0.0), ("a", 3.0, 1.0), ("b", 5.0, 0.0), (None, 2.0, 0.0), (None, 4.0, 1.0)]
    assert rows(layout.min_max_scaled(df.where("g = 'b'"), ["v"])) == [("b", 5.0, 0.0)]
