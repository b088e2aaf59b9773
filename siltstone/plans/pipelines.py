"""Queries that run through files, versions and streams; all end in rows that SQL over the tables gives too."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.runlog import with_keys
from ..operators.snapshots import Snapshots
from ..registry import query
from ..session import load, shared_folder
from ..sources import files
from ..streaming import streams


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/siltstone/{uuid.uuid4().hex}"


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def files_ledger_copy_into(spark, folder):
    """Load, load again (nothing new), load by force."""
    at = _folder(spark)
    load(spark, folder, "events").select("event_id", "event_type").write.json(f"{at}/in")
    sizes = [files.copy_into(spark, f"{at}/in", f"{at}/t", "json", schema="event_id long, event_type string", glob="*.json", force=f) for f in (False, False, True)]
    assert sizes[0] > 0 and sizes[1] == 0 and sizes[2] == sizes[0], sizes
    return files.loaded(spark, f"{at}/t").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def time_travel_restore(spark, folder):
    t = Snapshots(spark, _folder(spark))
    t.write(load(spark, folder, "orders").select("o_orderkey", "o_orderstatus"))
    t.write(t.read().where("o_orderkey % 2 = 0"))
    t.restore(0)
    return t.read()


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def txn_rollback(spark, folder):
    t = Snapshots(spark, _folder(spark))
    t.write(load(spark, folder, "orders").select("o_orderkey", "o_orderstatus"))

    def work(x):
        x.write(x.read().where("o_orderkey < 100"))
        raise RuntimeError("stop")

    try:
        t.guarded(work)
    except RuntimeError:
        pass
    return t.read()


@query("SELECT count(*) AS n FROM orders")
def publish_gate(spark, folder):
    """The newest version that has all statuses."""
    t = Snapshots(spark, _folder(spark))
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    t.write(orders)
    t.write(orders.where("o_orderstatus = 'F'"))
    t.publish("published_orders", [lambda df: F.count_distinct("o_orderstatus") > 1])
    return spark.table("published_orders").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, _change_type, _commit_version FROM (SELECT o_orderkey, 'delete' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 'update_preimage', CAST(2 AS BIGINT) FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT o_orderkey, 'update_postimage', CAST(2 AS BIGINT) FROM orders WHERE o_orderkey % 4 = 2) x""")
def cdf_versions(spark, folder):
    t = Snapshots(spark, _folder(spark))
    t.write(load(spark, folder, "orders").select("o_orderkey", "o_orderstatus"))
    t.write(t.read().where("o_orderkey % 4 <> 1"))
    t.write(t.read().withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 2, "Z").otherwise(F.col("o_orderstatus"))))
    return t.changes(0, ["o_orderkey"]).select("o_orderkey", "_change_type", "_commit_version")


@query("SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def identity_keys(spark, folder):
    return with_keys(load(spark, folder, "customer").select("c_custkey"), "id", 1000, ["c_custkey"]).select("c_custkey", "id")


def _event_files(spark, folder, at: str):
    events = streams.timed(load(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", F.round("value", 4).alias("value")))
    events.repartitionByRange(4, "event_id").write.parquet(f"{at}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "2").parquet(f"{at}/in"), events


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1")
def stream_ingest_merge(spark, folder):
    """Files arrive in two micro-batches; each is merged into the newest version."""
    at = _folder(spark)
    stream, events = _event_files(spark, folder, at)
    t = Snapshots(spark, f"{at}/t")
    streams.drain(stream, f"{at}/c", each=streams.scd1_sink(t, events.limit(0), ["user_id"], "event_id"))
    return t.read().select("user_id", "event_id", "event_type")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_watermark_window(spark, folder):
    """Windows of a stream that arrives in the order of time, each written once when the watermark has passed it and then
    forgotten; a closing event, three hours after the last one, lets the last windows end."""
    at = _folder(spark)
    events = streams.timed(load(spark, folder, "events")).select("ts", "event_type")
    cuts = [None, *events.agg(F.percentile_approx("ts", [0.33, 0.67])).first()[0], None]
    for low, high in zip(cuts[:-1], cuts[1:]):
        part = events.where((F.col("ts") > F.lit(low)) if low else F.lit(True)).where((F.col("ts") <= F.lit(high)) if high else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts")).select("ts", F.lit("closing").alias("event_type"))
    closing.write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(f"{at}/in")
    counted = streams.windowed(stream, "ts", "10 minutes", "1 hour", {"n": F.count("*")}, ["event_type"])
    streams.drain(counted, f"{at}/c", f"{at}/out")
    return spark.read.schema(counted.schema).parquet(f"{at}/out")


@query("""SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS gap FROM events) a) b GROUP BY user_id, s""")
def event_sessions(spark, folder):
    return streams.sessions(streams.timed(load(spark, folder, "events")), "ts", "10 minutes", "6 hours", {"n": F.count("*")}, ["user_id"])


@query("""SELECT user_id, event_type, ts AS start_time, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS end_time, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS is_current FROM
(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM (SELECT user_id, ts, max(event_type) AS event_type FROM events GROUP BY 1, 2) a) b WHERE before IS NULL OR before <> event_type""")
def stream_scd2(spark, folder):
    """History by micro-batches of a stream: files arrive in the order of time, one a batch."""
    at = _folder(spark)
    rows = streams.timed(load(spark, folder, "events")).groupBy("user_id", "ts").agg(F.max("event_type").alias("event_type"))
    middle = rows.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for part in (F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle)):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
    empty = rows.limit(0).select("user_id", "event_type", "ts", F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), F.lit(True).alias("is_current"))
    t = Snapshots(spark, f"{at}/t")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{at}/in")
    streams.drain(stream, f"{at}/c", each=streams.scd2_sink(t, empty, ["user_id"], "ts", tracked=["event_type"]))
    return t.read().drop("ts")
