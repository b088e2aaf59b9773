"""Queries of merges, history, validation, monitoring, access and graphs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import access_kind, categorize, qualified_name, query_tag
from ..operators import access, costs, graph, intervals, merge, validate
from ..registry import query
from ..session import load

# --- merges -------------------------------------------------------------------------------------------------------
# orders before 2000 are the target; those from 1998 on come (again) with a higher price: each order is on one side at least


def _target(spark, folder):
    return load(spark, folder, "orders").where("year(o_orderdate) < 2000").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"), F.lit(1).alias("version"))


def _source(spark, folder):
    return load(spark, folder, "orders").where("year(o_orderdate) >= 1998").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") + 1000, 2).alias("price"), (F.col("o_orderkey") % 4).cast("int").alias("version"))


TARGET = "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS price, 1 AS version FROM orders WHERE year(o_orderdate) < 2000"
SOURCE = "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice + 1000, 2) AS price, CAST(o_orderkey % 4 AS INTEGER) AS version FROM orders WHERE year(o_orderdate) >= 1998"


@query(f"SELECT * FROM ({TARGET}) t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({SOURCE}) s) UNION ALL SELECT * FROM ({SOURCE}) s")
def merge_upsert(spark, folder):
    return merge.upsert(_target(spark, folder), _source(spark, folder), ["o_orderkey"])


@query(f"""SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, s.o_custkey) AS o_custkey, coalesce(t.o_orderstatus, s.o_orderstatus) AS o_orderstatus,
CASE WHEN t.o_orderkey IS NOT NULL AND s.version > t.version THEN s.price ELSE coalesce(t.price, s.price) END AS price, CASE WHEN t.o_orderkey IS NOT NULL AND s.version > t.version THEN s.version ELSE coalesce(t.version, s.version) END AS version
FROM ({TARGET}) t FULL JOIN ({SOURCE}) s ON t.o_orderkey = s.o_orderkey WHERE NOT (t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND s.version = 0) AND (t.o_orderkey IS NOT NULL OR s.o_orderstatus <> 'P')""")
def merge_clauses(spark, folder):
    t, s = merge.t, merge.s
    clauses = [merge.When("delete", s("version") == 0), merge.When("update", s("version") > t("version"), {"price": s("price"), "version": s("version")}), merge.When("insert", s("o_orderstatus") != "P")]
    return merge.merge(_target(spark, folder), _source(spark, folder), ["o_orderkey"], clauses)


@query(f"""SELECT o_orderkey, o_custkey, o_orderstatus, price, version FROM ({TARGET}) t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({SOURCE}) s WHERE version > 1)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, price, version FROM ({SOURCE}) s WHERE o_orderstatus <> 'F' AND (version > 1 OR o_orderkey NOT IN (SELECT o_orderkey FROM ({TARGET}) t))""")
def merge_cdc_delete(spark, folder):
    kind = F.when(F.col("o_orderstatus") == "F", merge.DELETE).otherwise(merge.AFTER)
    return merge.merge_changes(_target(spark, folder), _source(spark, folder).withColumn("_change_type", kind), ["o_orderkey"], "version")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, price, version FROM ({TARGET}) t UNION ALL SELECT * FROM ({SOURCE}) s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({TARGET}) t)")
def merge_insert_absent(spark, folder):
    return merge.insert_absent(_target(spark, folder), _source(spark, folder), ["o_orderkey"])


@query(f"SELECT t.o_orderkey, t.o_custkey, t.o_orderstatus, coalesce(s.price, t.price) AS price, t.version FROM ({TARGET}) t LEFT JOIN ({SOURCE}) s ON t.o_orderkey = s.o_orderkey")
def merge_update_only(spark, folder):
    return merge.update_columns(_target(spark, folder), _source(spark, folder), ["o_orderkey"], ["price"])


@query(f"SELECT * FROM ({TARGET}) t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({SOURCE}) s)")
def merge_delete_matching(spark, folder):
    return merge.delete_matching(_target(spark, folder), _source(spark, folder), ["o_orderkey"])


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1 AND o_orderstatus <> 'P'""")
def apply_changes_scd1(spark, folder):
    changes = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return merge.apply_changes(changes.limit(0), changes, ["o_custkey"], "seq", F.col("o_orderstatus") == "P").drop("seq")


@query("""WITH d AS (SELECT o_custkey, o_orderdate, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2),
c AS (SELECT *, lag(status) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS before FROM d)
SELECT o_custkey, status, o_orderdate AS start_time, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS end_time, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) IS NULL AS is_current FROM c WHERE before IS NULL OR before <> status""")
def scd2_history(spark, folder):
    rows = load(spark, folder, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    empty = rows.limit(0).select("o_custkey", "status", "o_orderdate", F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("end_time"), F.lit(True).alias("is_current"))
    first = merge.scd2_merge(empty, rows.where("year(o_orderdate) < 1998"), ["o_custkey"], "o_orderdate", ["status"])
    both = merge.scd2_merge(first, rows.where("year(o_orderdate) >= 1998"), ["o_custkey"], "o_orderdate", ["status"])
    return both.drop("o_orderdate")


@query(f"""WITH t AS ({TARGET}), s AS ({SOURCE}) SELECT o_orderkey, price, kind AS _change_type FROM (SELECT o_orderkey, price, 'insert' AS kind FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)
UNION ALL SELECT o_orderkey, price, 'delete' FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT t.o_orderkey, t.price, 'update_preimage' FROM t JOIN s USING (o_orderkey)
UNION ALL SELECT s.o_orderkey, s.price, 'update_postimage' FROM t JOIN s USING (o_orderkey)) x""")
def change_feed(spark, folder):
    return merge.changes_between(_target(spark, folder), _source(spark, folder), ["o_orderkey"]).select("o_orderkey", "price", "_change_type")


@query(SOURCE)
def change_feed_replay(spark, folder):
    before, after = _target(spark, folder), _source(spark, folder)
    changes = merge.changes_between(before, after, ["o_orderkey"]).withColumn("_commit_version", F.lit(1))
    return merge.replay(before, changes, ["o_orderkey"])


@query("""SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_custkey""")
def recompute_changed_aggregates(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    sums = [F.count("*").alias("orders"), F.sum("c").alias("cents")]
    old = orders.where("o_orderkey % 5 <> 0")
    return merge.recompute_changed(old.groupBy("o_custkey").agg(*sums), orders, orders.where("o_orderkey % 5 = 0"), ["o_custkey"], sums)


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1""")
def incremental_merge(spark, folder):
    events = load(spark, folder, "events").select("user_id", "event_id")
    first = merge.incremental_merge(None, events.where("event_id < 4000"), ["user_id"], "event_id")
    return merge.incremental_merge(first, events, ["user_id"], "event_id")


# --- validation ---------------------------------------------------------------------------------------------------

PERTURBED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 25 <> 1"


def _two(spark, folder):
    a = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    b = a.where("o_orderkey % 25 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return a, b


@query("SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS sha_hash FROM orders")
def row_hash(spark, folder):
    return validate.hashed(_two(spark, folder)[0], nulls="\u2400").select("o_orderkey", "sha_hash")


@query(f"""SELECT (SELECT count(*) FROM orders) AS original_rows, (SELECT count(*) FROM ({PERTURBED}) p) AS other_rows, (SELECT count(*) FROM orders) AS original_distinct, (SELECT count(*) FROM ({PERTURBED}) p) AS other_distinct, m AS matched_rows,
(SELECT count(*) FROM orders) - (SELECT count(*) FROM ({PERTURBED}) p) AS count_difference, round(1 - m / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS unmatched_share
FROM (SELECT count(*) AS m FROM orders JOIN ({PERTURBED}) p USING (o_orderkey, o_custkey, o_orderstatus)) x""")
def diff_summary(spark, folder):
    return validate.compare(*_two(spark, folder))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders EXCEPT SELECT * FROM ({PERTURBED}) p")
def rows_unmatched(spark, folder):
    return validate.unmatched(*_two(spark, folder))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders INTERSECT SELECT * FROM ({PERTURBED}) p")
def rows_matched(spark, folder):
    return validate.matched(*_two(spark, folder))


@query(f"SELECT column_name, differing_rows FROM (SELECT 'o_custkey' AS column_name, 0::BIGINT AS differing_rows UNION ALL SELECT 'o_orderstatus', count(*) FROM orders o JOIN ({PERTURBED}) p USING (o_orderkey) WHERE o.o_orderstatus <> p.o_orderstatus) x")
def column_profile(spark, folder):
    return validate.column_profile(*_two(spark, folder), ["o_orderkey"])


@query("""SELECT bucket, coalesce(a, 0) AS left_rows, coalesce(b, 0) AS right_rows, coalesce(a, 0) - coalesce(b, 0) AS difference FROM (SELECT date_trunc('day', o_orderdate) AS bucket, count(*) AS a FROM orders GROUP BY 1) x
FULL JOIN (SELECT date_trunc('day', l_shipdate) AS bucket, count(*) AS b FROM lineitem GROUP BY 1) y USING (bucket)""")
def rowcount_compare_by_day(spark, folder):
    return validate.row_count_difference(load(spark, folder, "orders"), load(spark, folder, "lineitem"), "o_orderdate", "l_shipdate", "day")


@query("SELECT rule, violations FROM (SELECT 'known status' AS rule, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS violations FROM orders UNION ALL SELECT 'price', count(*) FILTER (WHERE NOT o_totalprice > 2000) FROM orders) x")
def expectations(spark, folder):
    return validate.expectations(load(spark, folder, "orders"), {"known status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice") > 2000})[1]


# --- monitoring: events as queries that start at ts and run for value seconds -----------------------------------------


def _history(spark, folder):
    e = load(spark, folder, "events")
    start = F.col("ts").cast("timestamp")
    micros = F.round(F.col("value") * 1e6).cast("long")
    return e.select("event_id", "user_id", F.concat(F.lit("w"), F.col("user_id") % 3).alias("warehouse_id"), start.alias("start"), F.timestamp_micros(F.unix_micros(start) + micros).alias("end"), F.when(F.col("event_type") == "error", "FAILED").otherwise("FINISHED").alias("status"), F.round("value", 6).alias("seconds"))


@query("""SELECT warehouse_id, reason, count(*) AS n FROM (SELECT 'w' || CAST(user_id % 3 AS VARCHAR) AS warehouse_id, CASE user_id % 3 WHEN 0 THEN CASE WHEN event_type = 'error' AND round(value, 6) > 60 THEN 'ERROR_AND_SLA_BURST' WHEN event_type = 'error' THEN 'ERROR' WHEN round(value, 6) > 60 THEN 'SLA_BURST' END
WHEN 1 THEN CASE WHEN round(value, 6) > 30 THEN 'SLA_BURST' END ELSE CASE WHEN event_type = 'error' THEN 'ERROR' END END AS reason FROM events) x WHERE reason IS NOT NULL GROUP BY 1, 2""")
def sla_policy_reasons(spark, folder):
    policies = spark.createDataFrame([(1, ["w0"], ["FAILED", "FINISHED"], 60, "ALL"), (2, ["w1"], ["FAILED", "FINISHED"], 30, "SLA_BURST"), (3, ["w2"], ["FAILED"], 30, "ERROR")], "policy_id int, warehouse_ids array<string>, query_statuses array<string>, sla_seconds int, policy_mode string")
    return intervals.policy_alerts(_history(spark, folder), policies).groupBy("warehouse_id", "reason").agg(F.count("*").alias("n"))


LEVELS = """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), i AS (SELECT epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS e FROM events),
ev AS (SELECT greatest(s, lo) AS t, 1 AS d FROM i, b WHERE s < hi AND e > lo UNION ALL SELECT least(e, hi), -1 FROM i, b WHERE s < hi AND e > lo UNION ALL SELECT lo, 0 FROM b UNION ALL SELECT hi, 0 FROM b),
n AS (SELECT t, sum(d) AS d FROM ev GROUP BY t), w AS (SELECT CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS level, lead(t) OVER (ORDER BY t) - t AS m FROM n), l AS (SELECT level, sum(m) / 1000000.0 AS seconds FROM w WHERE m > 0 GROUP BY 1)"""


def _levels(spark, folder):
    h = _history(spark, folder)
    low, high = h.agg(F.min("start"), F.max("start")).first()
    return intervals.concurrency_levels(h, "start", "end", F.lit(low), F.lit(high))


@query(f"{LEVELS} SELECT level, round(CAST(seconds AS DOUBLE), 3) AS seconds FROM l")
def concurrency_levels(spark, folder):
    return _levels(spark, folder).withColumn("seconds", F.round("seconds", 3))


@query(f"""{LEVELS}, c AS (SELECT level, sum(seconds) OVER (ORDER BY level) / sum(seconds) OVER () AS cdf FROM l) SELECT min(level) FILTER (WHERE cdf >= 0.5 - 1e-12) AS p50, min(level) FILTER (WHERE cdf >= 0.95 - 1e-12) AS p95, min(level) FILTER (WHERE cdf >= 1 - 1e-12) AS p100 FROM c""")
def concurrency_quantiles(spark, folder):
    return intervals.concurrency_quantiles(_levels(spark, folder), (0.5, 0.95, 1.0))


@query("""WITH b AS (SELECT max(ts) - INTERVAL 7 DAY AS lo, max(ts) AS hi FROM events), q AS (SELECT ts AS s, make_timestamp(epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT)) AS e, event_type = 'error' AS f, round(value, 6) AS v FROM events)
SELECT count(*) AS touched, count(*) FILTER (WHERE s >= lo) AS arrivals, count(*) FILTER (WHERE e >= lo AND e < hi) AS completions, round(count(*) FILTER (WHERE f AND e >= lo AND e < hi) / CAST(count(*) FILTER (WHERE e >= lo AND e < hi) AS DOUBLE), 6) AS failure_rate,
round(quantile_cont(v, 0.95) FILTER (WHERE e >= lo AND e < hi), 4) AS p95 FROM q, b WHERE s < hi AND e > lo""")
def live_metrics(spark, folder):
    h = _history(spark, folder)
    high = h.agg(F.max("start")).first()[0]
    out = intervals.live_metrics(h, F.lit(high) - F.expr("INTERVAL 7 DAYS"), F.lit(high))
    return out.select("touched", "arrivals", "completions", "failure_rate", "p95")


@query("""SELECT category, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM (SELECT CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 'Timeout' WHEN event_type = 'error' AND user_id % 4 = 1 THEN 'Syntax' WHEN event_type = 'error' THEN 'Other' ELSE '' END AS category FROM events) x GROUP BY 1""")
def error_taxonomy(spark, folder):
    text = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 4 == 0, "Query timed out").when(F.col("user_id") % 4 == 1, "PARSE_SYNTAX_ERROR near").otherwise("unknown"))
    rules = (("Timeout", (("timed out",),)), ("Syntax", (("PARSE_SYNTAX_ERROR",),)))
    counts = load(spark, folder, "events").groupBy(categorize(text, rules).alias("category")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("category", "n", F.round(F.col("n") / F.col("total").cast("double"), 6).alias("share"))


@query("SELECT tag, count(*) AS n FROM (SELECT CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'UNTAGGED' END AS tag FROM events) x GROUP BY 1")
def query_tag_extract(spark, folder):
    statement = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("SELECT 1 -- QUERY_TAG: "), "event_type")).otherwise(F.lit("SELECT 1"))
    return load(spark, folder, "events").groupBy(query_tag(statement).alias("tag")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(cents, 0) AS cents, coalesce(late, 0) AS late FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS late FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON c_custkey = b.o_custkey""")
def per_user_metrics(spark, folder):
    orders = load(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count_if(F.col("o_orderstatus") == "P").alias("late"))
    joined = load(spark, folder, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "cents", "late")))


@query("""SELECT p_brand, CAST(cents AS DOUBLE) AS cost FROM (SELECT p_brand, sum(q * price) AS cents FROM (SELECT p_brand, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) u
JOIN (SELECT p_brand, CAST(max_by(p_size, p_partkey) AS BIGINT) AS price FROM part GROUP BY 1) p USING (p_brand) GROUP BY 1) x""")
def priced_usage(spark, folder):
    part = load(spark, folder, "part")
    usage = load(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").cast("long").alias("q"))
    prices = part.select("p_brand", F.col("p_size").cast("long").alias("price"), F.col("p_partkey").alias("since"))
    return costs.priced(usage, prices, "p_brand", "q", "price", "since").select("p_brand", F.col("cost").cast("double"))


# --- access and graphs ----------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, count(DISTINCT event_id) AS events, min(ts) AS first_access, max(ts) AS last_access FROM events GROUP BY 1, 2")
def access_history(spark, folder):
    return access.access_history(load(spark, folder, "events"), ["user_id", "event_type"], "ts")


@query("""SELECT c_mktsegment AS privilege, access, count(*) AS n FROM (SELECT c_mktsegment, CASE WHEN c_mktsegment IN ('BUILDING') THEN 'Read' WHEN c_mktsegment = 'MACHINERY' THEN 'Edit' ELSE 'Unknown' END AS access FROM customer) x GROUP BY 1, 2""")
def privilege_kinds(spark, folder):
    p = F.when(F.col("c_mktsegment") == "BUILDING", "SELECT").when(F.col("c_mktsegment") == "MACHINERY", "WRITE_FILES").otherwise("X")
    return load(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("privilege"), access_kind(p).alias("access")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT c_custkey AS user_name, n_nationkey AS object FROM customer JOIN nation ON c_nationkey = n_nationkey OR (c_custkey % 25 = n_nationkey)""")
def effective_access(spark, folder):
    customer, nation = load(spark, folder, "customer"), load(spark, folder, "nation")
    grants = nation.select(F.col("n_nationkey").alias("object"), F.concat(F.lit("g"), "n_nationkey").alias("grantee"))
    members = customer.select(F.concat(F.lit("u"), "c_custkey").alias("user_name"), F.concat(F.lit("g"), "c_nationkey").alias("group_name"))
    most = customer.agg(F.max("c_custkey")).first()[0] // 25 + 1
    own = nation.select(F.col("n_nationkey").alias("object"), F.explode(F.expr(f"transform(sequence(0, {most}), i -> concat('u', n_nationkey + 25 * i))")).alias("grantee"))
    return access.effective(grants.unionByName(own), members).select(F.expr("CAST(substring(user_name, 2) AS BIGINT)").alias("user_name"), "object").distinct()


@query("""SELECT qualified, count(*) AS n FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'spark_catalog.default.t' WHEN 1 THEN 'spark_catalog.s.t' ELSE 'c.s.t' END AS qualified FROM events) x GROUP BY 1""")
def qualified_names(spark, folder):
    name = F.when(F.col("user_id") % 3 == 0, "T").when(F.col("user_id") % 3 == 1, "s.`t`").otherwise("C.S.T")
    return load(spark, folder, "events").groupBy(qualified_name(name).alias("qualified")).agg(F.count("*").alias("n"))


def _graph(spark, folder):
    """Nations lie in regions; customers and suppliers in nations; orders join customers, and lines suppliers."""
    n, c, s = load(spark, folder, "nation"), load(spark, folder, "customer"), load(spark, folder, "supplier")
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = n.select(name("n", "n_nationkey").alias("id"), F.lit("nation").alias("type")).unionByName(n.select(name("r", "n_regionkey").alias("id"), F.lit("region").alias("type")).distinct())
    nodes = nodes.unionByName(c.select(name("c", "c_custkey").alias("id"), F.lit("customer").alias("type"))).unionByName(s.select(name("s", "s_suppkey").alias("id"), F.lit("supplier").alias("type")))
    edges = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("in").alias("relationship_type"))
    edges = edges.unionByName(c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit("in").alias("relationship_type"))).unionByName(s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("in").alias("relationship_type")))
    return nodes, edges


EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
v AS (SELECT 'n' || n_nationkey AS id, 'nation' AS type FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'region' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier)"""


@query(f"""WITH {EDGES}, d AS (SELECT id, count(*) FILTER (WHERE k = 0) AS o, count(*) FILTER (WHERE k = 1) AS i FROM (SELECT src AS id, 0 AS k FROM e UNION ALL SELECT dst, 1 FROM e) x GROUP BY 1)
SELECT id, type, in_degree, out_degree, degree, row_number() OVER (ORDER BY degree DESC, id) AS "rank" FROM (SELECT id, type, i AS in_degree, o AS out_degree, i + o AS degree FROM v JOIN d USING (id) ORDER BY degree DESC, id LIMIT 12) y""")
def graph_degree_top(spark, folder):
    return graph.top_connected(*_graph(spark, folder), n=12)


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), p AS (SELECT 'r1' AS node, ['r1'] AS path, 0 AS level UNION ALL SELECT u.dst, list_append(p.path, u.dst), p.level + 1 FROM p JOIN u ON p.node = u.src WHERE p.level < 3 AND NOT list_contains(p.path, u.dst))
SELECT node, type, level, array_to_string(path, ', ') AS path FROM p JOIN v ON p.node = v.id WHERE level > 0 AND type IN ('nation', 'supplier', 'region')""")
def graph_bfs(spark, folder):
    return graph.simple_paths(*_graph(spark, folder), start="r1", most_steps=3, types=["nation", "supplier", "region"])


@query(f"""WITH {EDGES}, n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS k FROM e GROUP BY 1), w0 AS (SELECT id, 1.0::DOUBLE / n AS w FROM v, n), w1 AS (SELECT e.dst AS id, sum(w * 0.85 / k) AS w FROM w0 JOIN e ON w0.id = e.src JOIN o ON o.src = e.src GROUP BY 1),
w2 AS (SELECT e.dst AS id, sum(w * 0.85 / k) AS w FROM w1 JOIN e ON w1.id = e.src JOIN o ON o.src = e.src GROUP BY 1) SELECT v.id, type, round(coalesce(w, 0) + 0.15 / n * (1 - 0.85 ** 2) / 0.15, 9) AS score FROM v CROSS JOIN n LEFT JOIN w2 ON v.id = w2.id""")
def graph_pagerank(spark, folder):
    return graph.pagerank(*_graph(spark, folder)).withColumn("score", F.round("score", 9))
