"""Snapshot strategies, a ledger of processed times, triggers, and micro-batches merged into partitions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.operators import merge
from siltstone.operators.partitions import PartitionedTable
from siltstone.streaming import streams

AT = [datetime(2024, 1, k) for k in range(1, 8)]
SCHEMA = "id int, v string, at timestamp"


def _run(spark, states, hard_deletes=False, **options):
    history = None
    for k, rows in enumerate(states):
        history = merge.snapshot(history, spark.createDataFrame(rows, SCHEMA), ["id"], F.lit(AT[k + 3]), hard_deletes=hard_deletes, **options)
    return sorted(((r.id, r.v, r.valid_from, r.valid_to) for r in history.collect()), key=str)


def test_snapshot_by_time_takes_newer_rows_alone(spark):
    states = [[(1, "a", AT[0]), (2, "b", AT[0])], [(1, "x", AT[0]), (2, "c", AT[1])], [(2, "d", AT[0]), (3, "e", None)]]
    got = _run(spark, states, updated_at="at")
    assert got == sorted([(1, "a", AT[0], None), (2, "b", AT[0], AT[1]), (2, "c", AT[1], None), (3, "e", None, None)], key=str)


def test_snapshot_by_check_and_deletes(spark):
    states = [[(1, "a", AT[0]), (2, None, AT[0])], [(1, "a", AT[2]), (2, "b", AT[0])], [(2, None, AT[0])], [(1, "a", AT[0]), (2, None, AT[0])]]
    got = _run(spark, states, hard_deletes=True, check=["v"])
    assert got == sorted([(1, "a", AT[3], AT[5]), (2, None, AT[3], AT[4]), (2, "b", AT[4], AT[5]), (2, None, AT[5], None), (1, "a", AT[6], None)], key=str)
    with pytest.raises(Exception, match="several source rows"):
        _run(spark, [[(1, "a", AT[0]), (1, "b", AT[0])]], check=["v"])
    with pytest.raises(ValueError):
        _run(spark, states)


def test_time_ledger(spark, tmp_path):
    ledger = streams.TimeLedger(spark, f"{tmp_path}/l", "at")
    rows = spark.createDataFrame([(1, "a", AT[0]), (2, "b", AT[1]), (3, "c", None)], SCHEMA)
    assert sorted(r.id for r in ledger.pending(rows).collect()) == [1, 2]
    ledger.record(rows.where("id = 1"))
    ledger.record(rows.where("id = 1"))
    assert [r.id for r in ledger.pending(rows).collect()] == [2] and spark.read.parquet(f"{tmp_path}/l").count() == 1


def test_triggers_and_targets(spark, tmp_path):
    for k in range(4):
        spark.range(k * 5, k * 5 + 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    seen = []
    streams.start(stream, f"{tmp_path}/c1", "once", each=lambda df, i: seen.append(df.count())).awaitTermination(120)
    assert seen == [20]
    streams.start(stream, f"{tmp_path}/c2", path=f"{tmp_path}/out").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    spark.sql("DROP TABLE IF EXISTS stream_target")
    running = streams.start(stream, f"{tmp_path}/c3", "1 second", table="stream_target", name="every_second")
    try:
        running.processAllAvailable()
        assert running.isActive and running.name == "every_second" and spark.table("stream_target").count() == 20
    finally:
        running.stop()
        spark.sql("DROP TABLE IF EXISTS stream_target")
    with pytest.raises(ValueError):
        streams.start(stream, f"{tmp_path}/c4")


def test_micro_batches_merge_into_partitions(spark, tmp_path):
    table = PartitionedTable(spark, f"{tmp_path}/t", ["p"])
    table.create(spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("p"), F.lit(0).alias("v")))
    schema = "id long, p int, v int"
    for v, ids in ((1, (3, 13, 23)), (2, (13, 4, 200))):
        spark.createDataFrame([(i, i % 10, v) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    streams.drain(stream, f"{tmp_path}/c", each=table.sink(lambda now, new: merge.upsert(now, new, ["id"])))
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == 101 and (got[3], got[13], got[23], got[4], got[200], got[5]) == (1, 2, 1, 2, 2, 0)


def test_owned_tables(spark, tmp_path):
    from siltstone.operators.runlog import CODE_PATH_USER, SESSION, USER, OwnedTables

    at = lambda session, user, code, scope: OwnedTables(spark, f"{tmp_path}/o", session, user, code, scope)
    one, two = spark.range(3), spark.range(10, 14)
    a = at("s1", "ann", "x", SESSION)
    assert a.mine() == [] and a.save("t", one).count() == 3 and a.save("t", two, append=True).count() == 7 and a.mine() == ["t"]
    for other in (at("s2", "ann", "x", SESSION), at("s2", "ann", "y", CODE_PATH_USER), at("s2", "bob", "x", USER)):
        for refused in (lambda t: t.save("t", one), lambda t: t.drop("t")):
            with pytest.raises(PermissionError):
                refused(other)
    assert at("s2", "ann", "x", CODE_PATH_USER).save("t", one, append=True).count() == 3  # taken over, so overwritten
    assert a.mine() == [] and at("s3", "ann", "y", USER).save("t", two).count() == 4
    assert a.save("t", one, force=True).count() == 3 and a.drop_mine() == ["t"] and a.owner("t") is None


def test_statement_results_are_typed_or_cast(spark):
    from pyspark.sql import types as T

    from siltstone.sources.paged import statement_result

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    assert [tuple(r) for r in statement_result(spark, [[1, 2.5], [None, 3.0]], schema).collect()] == [(1, 2.5), (None, 3.0)]
    assert [tuple(r) for r in statement_result(spark, [["1", "2.5"], ["x", 3.0]], schema).collect()] == [(1, 2.5), (None, 3.0)]


def test_migration_makes_tables_before_views(spark):
    from siltstone.sources.paged import migrate

    class Log:
        def __init__(self):
            self.there, self.tried = set(), []

        def sql(self, statement):
            name, _, needs = statement.partition("<")
            self.tried.append(name)
            if needs and needs not in self.there:
                raise ValueError(needs)
            self.there.add(name)
            return spark.range(1)

    rows = [("s", "t1", "t1", 1), ("s", "a_view", "a_view<z_view", 2), ("s", "z_view", "z_view<t2", 2), ("s", "t2", "t2", 1), ("s", "lost", "lost<none", 2)]
    log = Log()
    said = {r["table_name"]: r["status"] for r in migrate(log, spark.createDataFrame(rows, "schema_name string, table_name string, statement string, step int"), most=2)}
    assert said == {"t1": "SUCCEEDED", "t2": "SUCCEEDED", "a_view": "SUCCEEDED", "z_view": "SUCCEEDED", "lost": "FAILED"}
    assert set(log.tried[:2]) == {"t1", "t2"}
