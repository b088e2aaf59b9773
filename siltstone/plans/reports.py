"""Queries of query facts, costs, policies, column profiles, access, lineage and graphs of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions
from ..operators import access, costs, graph, intervals, layout, profile, validate
from ..registry import query
from ..session import load
from ..streaming import streams

# --- facts: events as queries of a history, with durations and bytes made from their value ----------------------------

HISTORY = """SELECT event_id, 'w' || CAST(user_id % 3 AS VARCHAR) AS warehouse_id, ts AS start_time, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS execution_status, CAST(floor(value * 1000) AS BIGINT) AS total_duration_ms,
CAST(floor(value * 100) AS BIGINT) AS compilation_duration_ms, CAST(floor(value * 10) AS BIGINT) AS waiting_at_capacity_duration_ms, CAST(floor(value * 100000) AS BIGINT) AS read_bytes, CAST(floor(value * 1000) AS BIGINT) AS written_bytes,
CASE WHEN value > 50 THEN CAST(floor(value) AS BIGINT) END AS spilled_bytes, CAST(floor(value) AS BIGINT) AS read_files, CAST(floor(value / 2) AS BIGINT) AS pruned_files FROM events"""


def _history(spark, folder):
    whole = lambda x: F.floor(x).cast("long")
    v = F.col("value")
    return load(spark, folder, "events").select(
        "event_id", F.concat(F.lit("w"), F.col("user_id") % 3).alias("warehouse_id"), F.col("ts").alias("start_time"), F.when(F.col("event_type") == "error", "FAILED").otherwise("FINISHED").alias("execution_status"),
        whole(v * 1000).alias("total_duration_ms"), whole(v * 100).alias("compilation_duration_ms"), whole(v * 10).alias("waiting_at_capacity_duration_ms"), whole(v * 100000).alias("read_bytes"), whole(v * 1000).alias("written_bytes"),
        F.when(v > 50, whole(v)).alias("spilled_bytes"), whole(v).alias("read_files"), whole(v / 2).alias("pruned_files"),
    )


FACTS = f"""SELECT *, execution_status = 'FAILED' AS is_failed, coalesce(spilled_bytes > 0, false) AS is_spilled, read_bytes / 1073741824.0::DOUBLE AS read_gb, CASE WHEN pruned_files + read_files > 0 THEN pruned_files / CAST(pruned_files + read_files AS DOUBLE) ELSE 0 END AS pruned_share,
CASE WHEN total_duration_ms > 0 THEN compilation_duration_ms / CAST(total_duration_ms AS DOUBLE) ELSE 0 END AS compile_share FROM ({HISTORY}) h"""


@query(f"SELECT event_id, is_failed, is_spilled, round(read_gb * 1000, 6) AS read_mb, round(pruned_share, 6) AS pruned_share, round(compile_share, 6) AS compile_share FROM ({FACTS}) f")
def query_facts(spark, folder):
    return costs.query_facts(_history(spark, folder)).select("event_id", "is_failed", "is_spilled", F.round(F.col("read_gb") * 1000, 6).alias("read_mb"), F.round("pruned_share", 6).alias("pruned_share"), F.round("compile_share", 6).alias("compile_share"))


@query(f"""SELECT warehouse_id, CAST(start_time AS DATE) AS day, count(*) AS queries, round(count(*) FILTER (WHERE is_failed) / CAST(count(*) AS DOUBLE), 6) AS failed_share, round(count(*) FILTER (WHERE is_spilled) / CAST(count(*) AS DOUBLE), 6) AS spilled_share,
CAST(sum(waiting_at_capacity_duration_ms) AS BIGINT) AS queued_ms FROM ({FACTS}) f GROUP BY 1, 2""")
def warehouse_summary(spark, folder):
    return costs.warehouse_summary(costs.query_facts(_history(spark, folder))).drop("read_gb")


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'JOB' WHEN event_type = 'view' THEN 'DASHBOARD' WHEN value > 50 THEN 'NOTEBOOK' ELSE 'UNKNOWN' END AS source FROM events""")
def query_sources(spark, folder):
    cases = [(F.when(F.col("user_id") % 4 == 0, F.col("user_id")), "JOB"), (F.when(F.col("event_type") == "view", F.col("event_id")), "DASHBOARD"), (F.when(F.col("value") > 50, F.col("value")), "NOTEBOOK")]
    return load(spark, folder, "events").select("event_id", expressions.first_of(cases, "UNKNOWN").alias("source"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts END AS clamped, greatest(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00'), 0) / 1000000.0::DOUBLE AS queued FROM events""")
def clamped_times(spark, folder):
    """Times from epoch milliseconds, null beyond a range of years; waiting times are never negative."""
    e = load(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    millis = F.when(F.col("event_id") % 2 == 0, F.floor(F.unix_micros(ts) / 1000)).otherwise(F.lit(-5)).cast("long")
    exact = intervals.clamped_time(millis) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.pmod(F.unix_micros(ts), F.lit(1000)) / 1e6).cast("decimal(18,6)"))
    return e.select("event_id", exact.alias("clamped"), intervals.queue_seconds(F.lit("2024-01-15 00:00:00").cast("timestamp"), ts).alias("queued"))


TEXTS = [
    "[PARSE_SYNTAX_ERROR] near", "[PARSE_EMPTY_STATEMENT]", "[MISSING_COLUMN] x", "[OPERATION_REQUIRES_UNITY_CATALOG]", "Catalog namespace is not supported", "Query timed out", "ExecutorLostFailure (executor 3)", "Job aborted due to stage failure",
    "Database d not found", "Table t not found", "Database d already exists", "Table t already exists", "column c already exists", "v is a view. DESCRIBE DETAIL is only supported for tables.", "User does not own t", "no permission", "data type mismatch",
    "Reference x is ambiguous", "needs protocol 3", "[parse_syntax_error]", "",
]
#: The category of each text: one text for each group of words of a category, then one without, and none.
KINDS = [name for name, groups in expressions.ERROR_RULES for _ in groups] + ["Other", ""]
_KINDS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(KINDS))


@query(f"SELECT category, count(*) AS n FROM events JOIN (VALUES {_KINDS}) k(i, category) ON event_id % {len(KINDS)} = i GROUP BY 1")
def error_categories(spark, folder):
    texts = F.array(*map(F.lit, TEXTS))
    message = F.get(texts, (F.col("event_id") % len(TEXTS)).cast("int"))
    return load(spark, folder, "events").groupBy(expressions.categorize(message).alias("category")).agg(F.count("*").alias("n"))


# --- costs and policies -------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT event_type, ts, CAST(floor(value) AS BIGINT) * CASE event_type WHEN 'purchase' THEN 4 WHEN 'view' THEN 2 ELSE 1 END * CASE WHEN event_type IN ('purchase', 'click') THEN 0.5 ELSE 1 END AS cost FROM events)
SELECT event_type, hour, cost, budget AS hourly_budget, coalesce(cost > budget, false) AS over_budget FROM (SELECT event_type, date_trunc('hour', ts) AS hour, CAST(sum(cost) AS DOUBLE) AS cost FROM c GROUP BY 1, 2) h LEFT JOIN (VALUES ('purchase', 60.0::DOUBLE), ('view', 90.0)) b(sku, budget) ON sku = event_type""")
def budget_check(spark, folder):
    """Usage at list prices less discounts, by hour, against budgets."""
    events = load(spark, folder, "events")
    usage = events.select("event_type", F.col("ts").alias("usage_start_time"), F.floor("value").cast("long").alias("units"))
    kinds = events.select("event_type").distinct()
    price = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "view", 2).otherwise(1).cast("double")
    prices = kinds.select("event_type", price.alias("price"), F.lit(2).alias("since")).unionByName(kinds.select("event_type", F.lit(99.0).alias("price"), F.lit(1).alias("since")))
    priced = costs.priced(usage, prices, "event_type", "units", "price", "since", {"PURCHASE": 0.5, "click": 0.5})
    budgets = spark.createDataFrame([("purchase", 60.0), ("view", 90.0)], "event_type string, hourly_budget double")
    return costs.against_budget(priced, budgets, "event_type").select("event_type", "hour", "cost", "hourly_budget", "over_budget")


@query("""SELECT event_type, h, round(avg(v) OVER (PARTITION BY event_type ORDER BY h DESC ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling_4, round(avg(v) OVER (PARTITION BY event_type ORDER BY h DESC ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 6) AS rolling_12,
round(avg(v) OVER (PARTITION BY event_type ORDER BY h DESC ROWS BETWEEN 72 PRECEDING AND CURRENT ROW), 6) AS rolling_72 FROM (SELECT event_type, date_trunc('hour', ts) AS h, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY 1, 2) x""")
def rolling_backwards(spark, folder):
    """Windows over rows in descending order, so each mean looks ahead in time."""
    hourly = load(spark, folder, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.sum(F.floor("value").cast("long")).cast("double").alias("v"))
    names = {f"rolling_{n}": n for n in (4, 12, 72)}
    return costs.rolling(hourly, "v", [F.desc("h")], names, ["event_type"]).select("event_type", "h", *(F.round(n, 6).alias(n) for n in names))


@query("""SELECT n_nationkey AS policy_id, sha256('w' || n_nationkey || ',w' || n_regionkey || CAST(30 * (n_regionkey + 1) AS VARCHAR) || CASE n_regionkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'SLA_BURST' ELSE 'ERROR' END) AS policy_hash FROM nation""")
def policy_hashes(spark, folder):
    mode = F.when(F.col("n_regionkey") % 3 == 0, "ALL").when(F.col("n_regionkey") % 3 == 1, "SLA_BURST").otherwise("ERROR")
    ids = F.array(F.concat(F.lit("w"), F.col("n_nationkey")), F.concat(F.lit("w"), F.col("n_regionkey")))
    policies = load(spark, folder, "nation").select(F.col("n_nationkey").alias("policy_id"), ids.alias("warehouse_ids"), (30 * (F.col("n_regionkey") + 1)).alias("sla_seconds"), mode.alias("policy_mode"))
    return intervals.checked_policies(policies).select("policy_id", "policy_hash")


@query("SELECT event_type, quantile_disc(CAST(floor(value * 1000) AS BIGINT), 0.5) AS p50, quantile_disc(CAST(floor(value * 1000) AS BIGINT), 0.9) AS p90 FROM events GROUP BY 1")
def approximate_percentiles(spark, folder):
    """By group, combined before the shuffle; exact for groups with fewer values than the accuracy."""
    v = F.floor(F.col("value") * 1000).cast("long")
    return load(spark, folder, "events").groupBy("event_type").agg(F.percentile_approx(v, 0.5, 1_000_000).alias("p50"), F.percentile_approx(v, 0.9, 1_000_000).alias("p90"))


# --- profiles -----------------------------------------------------------------------------------------------------------

STATEMENTS = [
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 5", "select count(*) from Orders group by o_orderpriority", "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'x'",
    "UPDATE other SET a = 1",
]
COLUMNS = [("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")] + [("customer", c) for c in ("c_custkey", "c_mktsegment")]


def _statements(spark, folder):
    text = F.get(F.array(*map(F.lit, STATEMENTS)), (F.col("event_id") % len(STATEMENTS)).cast("int"))
    return load(spark, folder, "events").select(text.alias("query_text"), F.col("ts").alias("start"), F.floor("value").cast("long").alias("duration_ms"))


@query(f"""SELECT i, count(*) AS runs, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms FROM events JOIN (VALUES {', '.join(f"({i})" for i in range(len(STATEMENTS)))}) v(i) ON event_id % {len(STATEMENTS)} = i GROUP BY 1""")
def statement_summaries(spark, folder):
    number = F.array_position(F.array(*map(F.lit, STATEMENTS)), F.col("query_text")).cast("int") - 1
    return profile.summaries(_statements(spark, folder)).select(number.alias("i"), "runs", "total_ms")


_USES = [(0, "orders", "o_orderstatus", 1, 0, 0), (0, "orders", "o_totalprice", 1, 0, 0), (1, "orders", "o_orderpriority", 0, 0, 1), (2, "orders", "o_custkey", 0, 1, 0), (2, "customer", "c_custkey", 0, 1, 0), (2, "customer", "c_mktsegment", 1, 0, 0)]
_USED = ", ".join(f"({i}, '{t}', '{c}', {f}, {j}, {g})" for i, t, c, f, j, g in _USES)


@query(f"""SELECT table_name, column_name, count(*) AS queries, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(f) AS BIGINT) AS is_filter, CAST(sum(j) AS BIGINT) AS is_join, CAST(sum(g) AS BIGINT) AS is_group FROM (VALUES {_USED}) u(i, table_name, column_name, f, j, g)
JOIN (SELECT event_id % {len(STATEMENTS)} AS i, count(*) AS runs FROM events GROUP BY 1) e USING (i) GROUP BY 1, 2""")
def column_usage(spark, folder):
    """Which columns the texts of a history use, in which role, and how often."""
    sums = profile.summaries(_statements(spark, folder))
    roles = profile.column_roles(sums, spark.createDataFrame(COLUMNS, "table_name string, column_name string"))
    return profile.column_usage(roles, sums).drop("total_ms")


@query("""SELECT 'orders' AS table_name, column_name, count(*) AS writes, avg(ms) AS mean_ms FROM (SELECT 'o_orderkey' AS column_name, CAST(floor(value) AS DOUBLE) AS ms FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'o_orderstatus', CAST(floor(value) AS DOUBLE) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'o_custkey', CAST(floor(value) AS DOUBLE) FROM events WHERE event_type = 'view') x GROUP BY 2""")
def merge_predicates(spark, folder):
    text = F.when(F.col("event_type") == "purchase", "(t.o_orderkey = s.o_orderkey AND o_orderstatus <> 'F')").when(F.col("event_type") == "view", "o_custkey = 5")
    operations = load(spark, folder, "events").select(F.lit("orders").alias("table_name"), F.col("event_id").alias("version"), text.alias("predicate"), F.floor("value").cast("double").alias("duration_ms"))
    return profile.merge_predicates(operations, spark.createDataFrame(COLUMNS, "table_name string, column_name string"))


@query("""SELECT c_mktsegment, c_custkey, round(coalesce((c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0), 0), 6) AS "c_acctbalScaled" FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def scaled_by_group(spark, folder):
    rows = load(spark, folder, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return layout.min_max_scaled(rows, ["c_acctbal"], ["c_mktsegment"]).select("c_mktsegment", "c_custkey", F.round("c_acctbalScaled", 6).alias("c_acctbalScaled"))


@query("""SELECT n_nationkey, CAST(ceil(row_number() OVER (ORDER BY n_name) / 4.0) AS BIGINT) AS group_number FROM nation""")
def balanced_groups(spark, folder):
    return profile.balanced_groups(load(spark, folder, "nation").select("n_nationkey", "n_name"), 4, F.col("n_name")).drop("n_name")


@query("""SELECT event_name, CASE WHEN place <= 3 THEN CASE place WHEN 1 THEN 'b' WHEN 2 THEN 'b' ELSE 'a' END ELSE 'new_job_' || CAST(ceil((place - 3) / 3.0) AS BIGINT) END AS job_name, place > 3 AS is_new
FROM (SELECT n_name AS event_name, row_number() OVER (ORDER BY n_name) AS place FROM nation) x""")
def stream_places(spark, folder):
    """New event names take the free places of jobs, then new jobs."""
    jobs = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "job_name string, event_names array<string>")
    return streams.place_streams(jobs, load(spark, folder, "nation").select(F.col("n_name").alias("event_name")), most=3)


# --- validation, masks and types ----------------------------------------------------------------------------------------


@query("SELECT side, name FROM (VALUES ('both', 'c_custkey'), ('only_left', 'c_name'), ('only_left', 'c_acctbal'), ('only_left', 'c_mktsegment'), ('only_left', 'c_nationkey'), ('only_right', 'balance')) v(side, name)")
def column_difference(spark, folder):
    customer = load(spark, folder, "customer")
    found = validate.column_difference(customer, customer.select("c_custkey", F.col("c_acctbal").alias("balance")))
    return spark.createDataFrame([(side, name) for side, names in found.items() for name in names], "side string, name string")


@query("""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def visible_and_masked(spark, folder):
    """Rows that a permission covers, with their names masked."""
    customer, nation = load(spark, folder, "customer"), load(spark, folder, "nation")
    permissions = nation.select(F.concat(F.lit("user"), F.col("n_regionkey")).alias("user_name"), F.col("n_nationkey").alias("c_nationkey"))
    return expressions.masked(expressions.visible_rows(customer, permissions, "user1", ["c_nationkey"]).select("c_custkey", "c_name"), ["c_name"])


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def cast_from_json(spark, folder):
    from pyspark.sql import types as T

    events = load(spark, folder, "events").withColumn("doc", F.concat(F.lit('{"event_id": "'), F.col("event_id"), F.lit('", '), F.substring("props", 2, 10_000)))
    return events.select(*expressions.cast_to(T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.IntegerType())]), "doc"))


@query("""SELECT event_type, n, first_k, last_k FROM (SELECT event_type, count(*) AS n, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS first_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS last_k FROM events GROUP BY 1) x""")
def map_and_struct_star(spark, folder):
    """A map from pairs, and a struct whose fields become columns by star."""
    k = F.get_json_object("props", "$.k").cast("long")
    sums = load(spark, folder, "events").groupBy("event_type").agg(F.struct(F.min(k).alias("first_k"), F.max(k).alias("last_k")).alias("range"), F.map_from_arrays(F.array(F.lit("n")), F.array(F.count("*"))).alias("metrics"))
    return sums.select("event_type", F.element_at("metrics", "n").alias("n"), "range.*")


# --- access, lineage, graphs ----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT c_custkey, 'level=region' AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT c_custkey, 'level=nation' FROM customer WHERE c_nationkey IN (3, 4)) x GROUP BY 1
UNION ALL SELECT c_custkey, '' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 AND c_nationkey NOT IN (3, 4)""")
def inherited_tags(spark, folder):
    """Customers lie in nations, which lie in regions: names a.b.c take the tags of all that they lie in."""
    c, n = load(spark, folder, "customer"), load(spark, folder, "nation")
    objects = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", "n_regionkey", "n_nationkey", "c_custkey").alias("full_name"))
    of_regions = n.where("n_regionkey = 1").select(F.col("n_regionkey").cast("string").alias("full_name"), F.lit("level").alias("tag_name"), F.lit("region").alias("tag_value")).distinct()
    of_nations = n.where("n_nationkey IN (3, 4)").select(F.concat_ws(".", "n_regionkey", "n_nationkey").alias("full_name"), F.lit("level").alias("tag_name"), F.lit("nation").alias("tag_value"))
    return access.inherited_tags(objects, access.all_tags([of_regions, of_nations])).select("c_custkey", F.array_join("tags", ",").alias("tags"))


def _lineage(spark, folder):
    """Orders flow from customers' tables into status tables."""
    o = load(spark, folder, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("source_table_full_name"), F.concat(F.lit("s"), "o_orderstatus").alias("target_table_full_name"), F.col("o_orderpriority").alias("source_column_name"), F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("created_by"), F.col("o_orderdate").alias("event_time"))


@query("""SELECT 'upstream' AS direction, 'c' || k AS full_name, k <> 2 AS "exists" FROM (SELECT DISTINCT o_custkey % 5 AS k FROM orders WHERE o_orderstatus = 'F') x""")
def lineage_related(spark, folder):
    tables = spark.createDataFrame([("c0",), ("c1",), ("c3",), ("c4",), ("sF",)], "full_name string")
    return access.related_objects(_lineage(spark, folder), tables, "sF")


@query("""SELECT 'c' || (o_custkey % 5) AS source_table_full_name, o_orderpriority AS source_column_name, count(*) AS reads, count(DISTINCT o_custkey % 7) AS users, max(o_orderdate) AS last_read FROM orders GROUP BY 1, 2""")
def lineage_columns(spark, folder):
    return access.column_usage(_lineage(spark, folder))


@query("""SELECT 'node' AS what, 'c' || c_custkey AS a, 'customer' AS b FROM customer UNION ALL SELECT 'edge', 'c' || o_custkey, 's' || o_orderstatus FROM orders""")
def graph_from_documents(spark, folder):
    """JSON documents become nodes and edges by their type."""
    c, o = load(spark, folder, "customer"), load(spark, folder, "orders")
    docs = c.select(F.to_json(F.struct(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("type"))).alias("raw"))
    links = o.select(F.to_json(F.struct(F.lit("relationship").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("source_ref"), F.concat(F.lit("s"), "o_orderstatus").alias("target_ref"), F.lit("has").alias("relationship_type"))).alias("raw"))
    nodes, edges = graph.split_documents(docs.unionByName(links))
    return nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("type").alias("b")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("SELECT 'n7' AS id, 'nation' AS type, n_name AS raw FROM nation WHERE n_nationkey = 7")
def graph_node_metadata(spark, folder):
    nodes = load(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("raw"))
    return graph.node_metadata(nodes, "n7")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR GROUP BY 1")
def relative_time(spark, folder):
    """Rows of the last 36 hours before a given now, which is a parameter."""
    events = load(spark, folder, "events")
    now = events.agg(F.max("ts")).first()[0]
    return events.where(F.col("ts") >= F.lit(now) - F.expr("INTERVAL 36 HOURS")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT p_size, n, round(sum(n) OVER (ORDER BY n DESC) / CAST(sum(n) OVER () AS DOUBLE), 6) AS peers_share FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) x""")
def cumulative_share_with_peers(spark, folder):
    """Rows with equal values share their cumulative value."""
    sizes = load(spark, folder, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return costs.pareto(sizes.withColumn("all", F.lit(1)), "n", "all").select("p_size", "n", F.round("cumulative", 6).alias("peers_share"))


@query("SELECT p_partkey, name FROM part JOIN (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS name FROM part) v ON contains(lower(p_name), lower(name))")
def text_mentions(spark, folder):
    part = load(spark, folder, "part")
    names = part.select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")).distinct()
    return profile.mentions(part.select("p_partkey", F.col("p_name").alias("text")), names).select("p_partkey", "name")


@query("""SELECT table_name, optimize, properties FROM (VALUES ('events', 'OPTIMIZE events', 'ALTER TABLE events SET TBLPROPERTIES (''target_file_size_mb'' = ''16'')'), ('orders', 'OPTIMIZE orders ZORDER BY (o_orderkey, o_custkey)', 'ALTER TABLE orders SET TBLPROPERTIES (''target_file_size_mb'' = ''716'')')) v(table_name, optimize, properties)""")
def layout_commands(spark, folder):
    """Statements for chosen columns and for sizes; a table without chosen columns is only compacted."""
    scores = spark.createDataFrame([("orders", "o_custkey", 2, True), ("orders", "o_orderkey", 1, True), ("orders", "o_orderstatus", 3, False), ("events", "ts", 1, False)], "table_name string, column_name string, rank long, chosen boolean")
    sizes = spark.createDataFrame([("orders", 3000 * layout.GB), ("events", layout.GB)], "table_name string, size_bytes long")
    return layout.commands(scores, sizes).select("table_name", "optimize", "properties")
