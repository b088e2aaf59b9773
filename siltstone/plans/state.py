"""Queries over stored sketches, levels over time, files' ranges, partitioned merges, paged sources and stateful streams."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import expressions
from ..operators import intervals, layout, merge, runlog, sketches
from ..operators.partitions import PartitionedTable
from ..registry import query
from ..session import ROCKSDB, load, new_folder
from ..sources.pages import PagedSource
from ..streaming import alerts, sinks, streams

# --- sketches -------------------------------------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS rows, true AS p50_close, true AS p95_close, true AS users_close FROM events WHERE ts >= (SELECT date_trunc('hour', max(ts)) - INTERVAL 7 DAY FROM events) GROUP BY 1""")
def week_from_sketches(spark, folder):
    """A week's percentiles and distinct users from stored hourly sketches, without reading events again; the events are only
    read to state the error: ranks within 0.02 of those asked for, distinct counts within 5 %."""
    events = load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_folder(spark, "sketches")
    sketches.hourly(events, "ts", ["event_type"], ["value"], ["user_id"]).write.parquet(path)
    stored = spark.read.parquet(path)
    since = stored.agg(F.max("hour") - F.expr("INTERVAL 7 DAYS")).first()[0]
    week = sketches.merged(stored.where(F.col("hour") >= F.lit(since)), ["event_type"])
    found = week.select("event_type", "rows", *(sketches.quantile("value", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95)), sketches.distinct("user_id").alias("users"))
    exact = events.where(F.col("ts") >= F.lit(since)).join(found, "event_type").groupBy("event_type", "rows", "p50", "p95", "users")
    share = lambda c: F.count_if(F.col("value") <= F.col(c)) / F.count("value")
    low = lambda c: F.count_if(F.col("value") < F.col(c)) / F.count("value")
    checked = exact.agg(F.count_distinct("user_id").alias("n"), *(((share(c) >= p - 0.02) & (low(c) <= p + 0.02)).alias(f"{c}_close") for c, p in (("p50", 0.5), ("p95", 0.95))))
    return checked.select("event_type", "rows", "p50_close", "p95_close", (F.abs(F.col("users") - F.col("n")) <= 0.05 * F.col("n")).alias("users_close"))


# --- levels over time -----------------------------------------------------------------------------------------------

LEVELS = """SELECT user_id, ts, max(CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 1 + CAST(floor(value) AS BIGINT) % 4 WHEN 'error' THEN 0 END) AS level FROM events WHERE event_type IN ('signup', 'click', 'error') GROUP BY 1, 2"""
STEPS = f"""SELECT user_id, level, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM
(SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM ({LEVELS}) a) b WHERE before IS NULL OR before <> level"""


def _steps(spark, folder):
    """Users as warehouses: a signup starts one cluster, a click scales to 1 to 4, an error stops all; many stops come twice,
    and many starts have no stop before them."""
    kind = F.col("event_type")
    level = F.when(kind == "signup", F.lit(1).cast("long")).when(kind == "click", 1 + F.floor("value").cast("long") % 4).when(kind == "error", F.lit(0).cast("long"))
    events = load(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), level.alias("level"))
    return events, intervals.step_levels(events, ["user_id"], "ts", "level")


@query(STEPS)
def warehouse_scaling(spark, folder):
    return _steps(spark, folder)[1].withColumnRenamed("end", "until")


@query(f"""SELECT user_id, day AS bucket, round(sum(s), 3) AS seconds, round(sum(s * level) / sum(s), 6) AS mean_level FROM
(SELECT user_id, level, day, epoch_us(least(until, day + INTERVAL 1 DAY)) / 1e6 - epoch_us(greatest(start, day)) / 1e6 AS s FROM
(SELECT *, unnest(generate_series(date_trunc('day', start), until - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS day FROM (SELECT user_id, level, start, coalesce(until, (SELECT max(ts) FROM events)) AS until FROM ({STEPS}) q) x WHERE start < until) y) z GROUP BY 1, 2""")
def warehouse_mean_clusters(spark, folder):
    """Time-weighted clusters of each day, up to the last event of all."""
    events, steps = _steps(spark, folder)
    last = load(spark, folder, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return intervals.time_weighted(steps, ["user_id"], F.lit(last)).select("user_id", "bucket", F.round("seconds", 3).alias("seconds"), F.round("mean_level", 6).alias("mean_level"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' THEN 'delete' ELSE 'edit' END AS action FROM events),
k AS (SELECT * FROM e WHERE action <> 'create' UNION ALL SELECT * FROM e WHERE action = 'create' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change_rank, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency_rank,
CASE WHEN action = 'delete' AND row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'Deleted' ELSE 'Active' END AS state FROM k""")
def warehouse_history(spark, folder):
    """Changes of warehouses from audit events: the last creation, all edits and deletions, ranked from both ends."""
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("edit")
    events = load(spark, folder, "events").select("user_id", "ts", "event_id", kind.alias("action"))
    return intervals.change_history(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "action", "change_rank", "recency_rank", "state")


# --- layout ---------------------------------------------------------------------------------------------------------


@query("SELECT 'l_partkey' AS column_name, true AS shallower, true AS fewer_files, count(*) AS rows FROM lineitem")
def layout_before_and_after(spark, folder):
    """Depth of overlap and files read for point predicates, as the rows come and clustered by two columns; the same rows."""
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    plain, dealt = new_folder(spark, "plain"), new_folder(spark, "clustered")
    lines.repartition(16).write.parquet(plain)
    layout.clustered(lines, ["l_partkey", "l_orderkey"], files=16).write.parquet(dealt)
    before, after = (layout.file_ranges(spark, p, ["l_partkey", "l_orderkey"]) for p in (plain, dealt))
    depth = lambda r: layout.overlap_depth(r, ["l_partkey"]).select("column_name", F.col("mean_depth").alias("depth"))
    points = load(spark, folder, "part").select(F.col("p_partkey").alias("low"), F.col("p_partkey").alias("high")).orderBy("low").limit(50)
    read = lambda r: layout.files_read(r, "l_partkey", points).agg(F.sum("files_read").alias("n"))
    both = depth(before).join(depth(after).withColumnRenamed("depth", "depth_after"), "column_name").crossJoin(read(before).withColumnRenamed("n", "files_before")).crossJoin(read(after))
    counts = after.agg(F.sum("rows").alias("rows"))
    return both.crossJoin(counts).select("column_name", (F.col("depth_after") < F.col("depth")).alias("shallower"), (F.col("n") < F.col("files_before")).alias("fewer_files"), "rows")


# --- merges and sinks -----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN hit THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, month FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 7 = 0 AND strftime(o_orderdate, '%Y-%m') IN
(SELECT DISTINCT strftime(o_orderdate, '%Y-%m') FROM orders ORDER BY 1 DESC LIMIT 2) AS hit FROM orders) x""")
def merge_touched_partitions(spark, folder):
    """Updates of the last two months rewrite these months' files alone."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    table = PartitionedTable(spark, new_folder(spark, "orders"), ["month"])
    table.create(orders)
    last = orders.select("month").distinct().orderBy(F.desc("month")).limit(2)
    changes = orders.join(last, "month", "left_semi").where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("Z"))
    table.merge(changes, lambda now, new: merge.upsert(now, new, ["o_orderkey"]))
    return table.read().select("o_orderkey", "o_orderstatus", "month")


@query("SELECT event_id, event_type, value FROM events")
def paged_source_stream(spark, folder):
    """A service's pages as a stream that is stopped half way and started again from its checkpoint; each row once."""
    at = new_folder(spark, "pages")
    events = load(spark, folder, "events").select("event_id", "event_type", "value")
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    spark.dataSource.register(PagedSource)
    stream = spark.readStream.format("pages").option("service", "siltstone.sources.pages:FolderLog").option("path", f"{at}/log").option("schema", "event_id long, event_type string, value double").load()
    for k, part in enumerate((F.col("event_id") <= middle, F.col("event_id") > middle)):
        sinks.add_pages(events.where(part).repartitionByRange(4, "event_id"), f"{at}/log", f"{k}")
        streams.drain(stream, f"{at}/c", f"{at}/out")
    return spark.read.schema(events.schema).parquet(f"{at}/out")


@query("SELECT event_id, event_type, value FROM events")
def paged_source_batch(spark, folder):
    """A service's pages as a table, a partition for each page; there are more pages, not longer ones, of a larger table."""
    at = new_folder(spark, "pages")
    events = load(spark, folder, "events").select("event_id", "event_type", "value")
    sinks.add_pages(events.repartitionByRange(6, "event_id"), f"{at}/log", "0")
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").option("service", "siltstone.sources.pages:FolderLog").option("path", f"{at}/log").option("schema", "event_id long, event_type string, value double").load()


@query("""SELECT CAST(event_id AS VARCHAR) AS query_id, CASE WHEN event_type = 'error' THEN 'STILL_RUNNING' ELSE 'LATE' END AS reason FROM events WHERE event_type = 'error' OR value > 60""")
def overdue_queries_stream(spark, folder):
    """Events as queries that last `value` minutes (errors never end) and may take an hour; the stream stops half way and goes
    on from its checkpoint. A query that ends late is told when its deadline passes or its end is read, whichever is first."""
    at = new_folder(spark, "overdue")
    events = load(spark, folder, "events").select(F.col("event_id").cast("string").alias("query_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    starts = events.select("query_id", F.col("ts").alias("at"), F.lit("RUNNING").alias("status"), F.lit(3600.0).alias("seconds"))
    until = F.timestamp_micros(F.unix_micros("ts") + (F.col("value") * 60_000_000).cast("long"))
    ends = events.where("event_type <> 'error'").select("query_id", until.alias("at"), F.lit("FINISHED").alias("status"), F.lit(None).cast("double").alias("seconds"))
    rows = starts.unionByName(ends)
    cuts = rows.agg(F.percentile_approx("at", [0.5]).alias("p"), F.max("at").alias("last")).first()
    closing = spark.range(1).select(F.lit("closing").alias("query_id"), (F.lit(cuts["last"]) + F.expr("INTERVAL 2 DAYS")).alias("at"), F.lit("FINISHED").alias("status"), F.lit(None).cast("double").alias("seconds"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for part in (rows.where(F.col("at") <= F.lit(cuts["p"][0])), rows.where(F.col("at") > F.lit(cuts["p"][0])).unionByName(closing)):
            part.write.mode("append").parquet(f"{at}/in")  # a half is a micro-batch
            stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
            streams.drain(alerts.overdue_alerts(stream), f"{at}/c", f"{at}/out")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = spark.read.schema(alerts.ALERTS).parquet(f"{at}/out")
    never = events.select("query_id", "event_type")
    return told.join(never, "query_id").select("query_id", F.when(F.col("event_type") == "error", F.col("reason")).otherwise("LATE").alias("reason"))


@query("SELECT event_id, CAST(1 AS BIGINT) AS times FROM events WHERE event_type = 'error'")
def outbox_alerts(spark, folder):
    """Alerts of a stream by way of an outbox whose receiver breaks off once; each is received once. Tasks send, so the driver
    holds none; the receiver, which stands for a service, keeps what it gets in a folder. A run that ends by any other failure
    than that break, or again, is an error."""
    at = new_folder(spark, "outbox")
    errors = load(spark, folder, "events").where("event_type = 'error'").select("event_id", "value")
    errors.repartitionByRange(16, "event_id").write.parquet(f"{at}/in")
    receiver = sinks.FolderReceiver(f"{at}/received", breaks=True)
    box = sinks.Outbox(spark, f"{at}/box", "errors", receiver.send, receiver.known, chunk=2000, tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = spark.readStream.schema(errors.schema).option("maxFilesPerTrigger", "8").parquet(f"{at}/in")
    try:
        streams.drain(stream, f"{at}/c", each=box)
    except StreamingQueryException as e:
        if receiver.BREAK not in str(e):
            raise
    streams.drain(stream, f"{at}/c", each=box)
    return spark.read.schema("message_id string, event_id long").json(f"{at}/received").groupBy("event_id").agg(F.count("*").alias("times"))


@query("""WITH b AS (SELECT max(ts) - INTERVAL 7 DAY AS lo, max(ts) AS hi FROM events), q AS (SELECT ts AS s, make_timestamp(epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT)) AS e, CASE WHEN value > 50 THEN 1 ELSE 0 END AS spilled FROM events),
n AS (SELECT count(*) FILTER (WHERE s >= lo) AS arrivals, count(*) FILTER (WHERE e >= lo AND e < hi) AS completions, count(*) FILTER (WHERE e >= lo AND e < hi AND spilled > 0) AS spills FROM q, b WHERE s < hi AND e > lo)
SELECT arrivals, completions, round(arrivals / 604800.0, 6) AS queries_a_second, round(60 * completions / 604800.0, 6) AS completed_a_minute, round(spills / CAST(completions AS DOUBLE), 6) AS spill_rate FROM n""")
def live_rates(spark, folder):
    """Queries a second and a minute, and the share that spilled, of the last week."""
    start = F.col("ts").cast("timestamp")
    h = load(spark, folder, "events").select(start.alias("start"), F.timestamp_micros(F.unix_micros(start) + F.floor(F.col("value") * 1_000_000).cast("long")).alias("end"), F.lit("FINISHED").alias("status"), F.col("value").alias("seconds"), F.when(F.col("value") > 50, 1).otherwise(0).alias("spilled"))
    high = h.agg(F.max("start")).first()[0]
    out = intervals.live_metrics(h, F.lit(high) - F.expr("INTERVAL 7 DAYS"), F.lit(high), spilled="spilled")
    return out.select("arrivals", "completions", "queries_a_second", "completed_a_minute", "spill_rate")


SNAPSHOT = """SELECT o_orderkey, status, day, CASE WHEN o_orderkey % 3 = 0 AND v = 1 THEN TIMESTAMP '2024-06-01' ELSE {first} END AS valid_from,
CASE WHEN v = 0 AND o_orderkey % 3 = 0 THEN TIMESTAMP '2024-06-01' WHEN v = 0 AND o_orderkey % 7 = 1 THEN TIMESTAMP '2024-07-01' END AS valid_to FROM
(SELECT o_orderkey, o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS day, 0 AS v FROM orders UNION ALL SELECT o_orderkey, 'Z', {second}, 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 1) x
WHERE NOT (v = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 7 = 1) UNION ALL
SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS TIMESTAMP), {first_o}, TIMESTAMP '2024-07-01' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 = 1"""


def _snapshots(spark, folder, by_time: bool):
    """Two states of the orders: in the second a third has another status and every seventh is gone."""
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("day"))
    hit = F.col("o_orderkey") % 3 == 0
    june, july = (F.lit(x).cast("timestamp") for x in ("2024-06-01", "2024-07-01"))
    later = orders.where("o_orderkey % 7 <> 1").withColumns({"status": F.when(hit, "Z").otherwise(F.col("status")), "day": F.when(hit & F.lit(by_time), june).otherwise(F.col("day"))})
    options = {"updated_at": "day"} if by_time else {"check": ["status"]}
    first = merge.snapshot(None, orders, ["o_orderkey"], F.lit("2024-05-01").cast("timestamp"), **options)
    second = merge.snapshot(first, later, ["o_orderkey"], june, **options)
    return merge.snapshot(second, later, ["o_orderkey"], july, hard_deletes=True, **options)


@query(SNAPSHOT.format(first="day", second="TIMESTAMP '2024-06-01'", first_o="CAST(o_orderdate AS TIMESTAMP)"))
def snapshot_by_time(spark, folder):
    return _snapshots(spark, folder, True)


@query(SNAPSHOT.format(first="TIMESTAMP '2024-05-01'", second="CAST(o_orderdate AS TIMESTAMP)", first_o="TIMESTAMP '2024-05-01'"))
def snapshot_by_check(spark, folder):
    return _snapshots(spark, folder, False)


@query("SELECT event_id, event_type FROM events")
def processed_times(spark, folder):
    """Two runs over a growing table; the second takes the days that the first hasn't recorded."""
    at = new_folder(spark, "times")
    events = load(spark, folder, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    middle = events.agg(F.percentile_approx(F.unix_date("day"), 0.5).alias("d")).first()[0]
    ledger = streams.TimeLedger(spark, f"{at}/ledger", "day")
    for rows in (events.where(F.unix_date("day") <= middle), events):
        new = ledger.pending(rows)
        new.write.mode("append").parquet(f"{at}/out")
        ledger.record(rows)
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type")


@query("SELECT 'nightly' AS table_name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'shared', 2 * count(*) FROM orders WHERE o_orderstatus = 'O'")
def owned_temp_tables(spark, folder):
    """A later session of the same user and code takes a table over; another user's may not, and its own it may add to."""
    at, orders = new_folder(spark, "owned"), load(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    first = runlog.OwnedTables(spark, at, "s1", "ann", "jobs/nightly", runlog.CODE_PATH_USER)
    later = runlog.OwnedTables(spark, at, "s2", "ann", "jobs/nightly", runlog.CODE_PATH_USER)
    other = runlog.OwnedTables(spark, at, "s3", "bob", "jobs/nightly", runlog.CODE_PATH_USER)
    first.save("nightly", orders)
    later.save("nightly", orders.where("o_orderstatus = 'F'"), append=True)
    for _ in range(2):
        other.save("shared", orders.where("o_orderstatus = 'O'"), append=True)
    try:
        other.save("nightly", orders)
    except PermissionError:
        pass
    counts = [t.get(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for t, n in ((later, "nightly"), (other, "shared"))]
    return counts[0].unionByName(counts[1])


# --- the layout advisor and the run log over given tables -----------------------------------------------------------

#: What a profile says of columns: table, column, reads, writes, scaled metrics, roles.
PROFILE = [("orders", "o_orderkey", 90, 20, 1.0, 3), ("orders", "o_custkey", 40, 5, 0.7, 2), ("orders", "o_orderstatus", 10, 0, 0.1, 1), ("lineitem", "l_partkey", 70, 1, 0.9, 1), ("lineitem", "l_quantity", 30, 2, 0.4, 1), ("lineitem", "l_returnflag", 20, 0, 0.2, 1)]
_PROFILE = ", ".join(str(x) for x in PROFILE)
_DISTINCT = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count(*) AS row_count FROM {t}" for t, c, *_ in PROFILE)


@query(f"""WITH s AS (SELECT *, round(distinct_count / CAST(row_count AS DOUBLE), 6) AS share FROM ({_DISTINCT}) d JOIN (VALUES {_PROFILE}) v(table_name, column_name, reads, writes, scaled_metrics, role_flags) USING (table_name, column_name)),
r AS (SELECT *, rank() OVER (PARTITION BY table_name ORDER BY score DESC) AS "rank" FROM (SELECT *, round(CAST(reads AS DOUBLE) * (1 + scaled_metrics + role_flags) * (0.001 + share) + writes * (0.001 + share), 6) AS score FROM s) x),
c AS (SELECT *, (("rank" <= 2 AND distinct_count >= 1000) OR (share >= 0.2 AND distinct_count >= 1000) OR (share >= 0.01 AND row_count >= 1000000)) AS chosen FROM r)
SELECT table_name, max(row_count) AS row_count, 'OPTIMIZE ' || table_name || coalesce(' ZORDER BY (' || string_agg(CASE WHEN chosen THEN column_name END, ', ' ORDER BY "rank", column_name) || ')', '') AS optimize FROM c GROUP BY table_name""")
def layout_advice(spark, folder):
    """From a profile of reads and writes and the tables' own statistics to a statement for each table."""
    profile = spark.createDataFrame(PROFILE, "table_name string, column_name string, reads long, writes long, scaled_metrics double, role_flags long")
    found = None
    for table in ("orders", "lineitem"):
        one = layout.cardinality(load(spark, folder, table), [c for t, c, *_ in PROFILE if t == table]).withColumn("table_name", F.lit(table))
        found = one if found is None else found.unionByName(one)
    scores = layout.layout_scores(found.join(profile, ["table_name", "column_name"]).withColumn("is_partition", F.lit(False)))
    sizes = found.groupBy("table_name").agg(F.max("row_count").alias("row_count")).withColumn("size_bytes", F.col("row_count") * 100)
    return layout.commands(scores, sizes).join(sizes, "table_name").select("table_name", "row_count", "optimize")


@query("""SELECT 'user ' || user_id AS process_name, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS running,
CAST(sum(CASE WHEN event_type <> 'view' THEN 1 + CAST(floor(value * 1000) AS BIGINT) END) AS BIGINT) AS total_ms FROM events GROUP BY 1""")
def logged_runs(spark, folder):
    """Events as runs of processes in a log of start and end rows: views never end, errors fail."""
    path = f"{new_folder(spark, 'runs')}/log"
    started = F.col("ts").cast("timestamp")
    ended = F.timestamp_micros(F.unix_micros(started) + 1000 * (1 + F.floor(F.col("value") * 1000).cast("long")))
    events = load(spark, folder, "events").withColumns({"run_id": F.col("event_id").cast("string"), "process_name": F.concat(F.lit("user "), "user_id")})
    none = {"note": F.lit(None).cast("string"), "metrics": F.lit(None).cast("string")}
    begin = events.select("run_id", "process_name", F.lit(runlog.RUNNING).alias("status"), started.alias("at"))
    end = events.where("event_type <> 'view'").select("run_id", "process_name", F.when(F.col("event_type") == "error", runlog.FAIL).otherwise(runlog.SUCCESS).alias("status"), ended.alias("at"))
    begin.unionByName(end).withColumns(none).write.parquet(path)
    runs = runlog.RunLog(spark, path).runs()
    return runs.groupBy("process_name").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == runlog.FAIL).alias("failed"), F.count_if(F.col("status") == runlog.RUNNING).alias("running"), F.sum(F.round(1000 * F.col("duration_seconds")).cast("long")).alias("total_ms"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name, c_name AS clear_name FROM customer WHERE c_nationkey % 3 = 0")
def rows_of_current_user(spark, folder):
    """Row filter and column mask by whoever runs the query: some nations are theirs; one mask has them as an exception."""
    customer = load(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_name").alias("clear_name"))
    who = F.when(F.col("n_nationkey") % 3 == 0, F.current_user()).otherwise("someone else")
    permissions = load(spark, folder, "nation").select(who.alias("user_name"), F.col("n_nationkey").alias("c_nationkey"))
    rows = expressions.masked(expressions.visible_rows(customer, permissions, on=["c_nationkey"]), ["c_name"], clear_for=["someone else"])
    me = spark.range(1).select(F.current_user()).first()[0]
    return expressions.masked(rows, ["clear_name"], clear_for=[me]).select("c_custkey", "c_name", "clear_name")
