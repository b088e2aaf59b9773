"""Relational queries over the tables: dedup, averages, trends, shares, top rows, joins, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import costs, dedup, layout
from ..registry import query, shared_sql
from ..session import load


# --- bronze to gold -----------------------------------------------------------------------------------------------


def hourly_activity(spark, folder):
    """Deduplicated events by user and hour."""
    events = load(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    clean = dedup.latest(events, ["user_id", "event_type", "ts"], "event_id")
    return clean.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour_bucket")).agg(F.avg("value").alias("avg_value"), F.count("*").alias("n_events"))


HOURLY = """SELECT user_id, date_trunc('hour', ts) AS hour_bucket, avg(value) AS avg_value, count(*) AS n_events
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1 GROUP BY 1, 2"""


@query(f"SELECT user_id, hour_bucket, round(avg_value, 8) AS avg_value, n_events FROM ({HOURLY}) h")
def gold_hourly_activity(spark, folder):
    return hourly_activity(spark, folder).withColumn("avg_value", F.round("avg_value", 8))


@query(f"""SELECT user_id, hour_bucket, round(avg_value, 8) AS avg_value,
round(avg(avg_value) OVER (PARTITION BY user_id ORDER BY hour_bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 8) AS ma_5,
round(avg(avg_value) OVER (PARTITION BY user_id ORDER BY hour_bucket ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 8) AS ma_25 FROM ({HOURLY}) h""")
def gold_smoothed_activity(spark, folder):
    smooth = costs.rolling(hourly_activity(spark, folder), "avg_value", ["hour_bucket"], {"ma_5": 4, "ma_25": 24}, ["user_id"])
    return smooth.select("user_id", "hour_bucket", *(F.round(c, 8).alias(c) for c in ("avg_value", "ma_5", "ma_25")))


@query(f"""SELECT hour_bucket, user_id, round(avg(avg_value) OVER w5, 8) AS ma_5, round(avg(avg_value) OVER w25, 8) AS ma_25 FROM ({HOURLY}) h
WINDOW w5 AS (ORDER BY hour_bucket, user_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w25 AS (ORDER BY hour_bucket, user_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)""")
def gold_interleaved_average(spark, folder):
    """All users' rows in one sequence: one task by its definition, over hourly rows."""
    smooth = costs.rolling(hourly_activity(spark, folder), "avg_value", ["hour_bucket", "user_id"], {"ma_5": 4, "ma_25": 24})
    return smooth.select("hour_bucket", "user_id", F.round("ma_5", 8).alias("ma_5"), F.round("ma_25", 8).alias("ma_25"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1""")
def dedup_latest_order(spark, folder):
    return dedup.latest(load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("""SELECT o_orderstatus, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS r FROM orders) x WHERE r = 1""")
def latest_snapshot(spark, folder):
    return dedup.top_rows(load(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate"), ["o_orderstatus"], [F.desc("o_orderdate")], rank="rank")


@query("""SELECT ship_month, l_partkey, quantity, r FROM (SELECT *, dense_rank() OVER (PARTITION BY ship_month ORDER BY quantity DESC) AS r FROM
(SELECT date_trunc('month', l_shipdate) AS ship_month, l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) a) b WHERE r <= 10""")
def topn_per_month(spark, folder):
    sums = load(spark, folder, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("ship_month"), "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    r = F.dense_rank().over(Window.partitionBy("ship_month").orderBy(F.desc("quantity")))
    return sums.withColumn("r", r.cast("long")).where("r <= 10")


@query("""SELECT user_id, max_by(event_type, ts) FILTER (WHERE event_type <> 'error') AS event_type, round(max_by(value, ts) FILTER (WHERE value > 10), 4) AS value,
max(ts) AS last_seen FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1) e GROUP BY user_id""")
def golden_record(spark, folder):
    events = dedup.latest(load(spark, folder, "events"), ["user_id", "ts"], "event_id")
    picked = dedup.golden_record(events, ["user_id"], "ts", {"event_type": F.col("event_type") != "error", "value": F.col("value") > 10}, [F.max("ts").alias("last_seen")])
    return picked.select("user_id", "event_type", F.round("value", 4).alias("value"), "last_seen")


@query("SELECT user_id, max(event_type) AS event_type, round(max(value), 4) AS value FROM events GROUP BY user_id")
def max_record(spark, folder):
    return dedup.max_record(load(spark, folder, "events"), ["user_id"], ["event_type", "value"]).withColumn("value", F.round("value", 4))


# --- trends -------------------------------------------------------------------------------------------------------

TREND = """SELECT h, v, avg(v) OVER (ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mean_12, avg(v) OVER (ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mean_24,
(v - lag(v, 12, 0.0) OVER (ORDER BY h)) / nullif(lag(v, 12, 0.0) OVER (ORDER BY h), 0) * 100 AS change_12, (v - lag(v, 24, 0.0) OVER (ORDER BY h)) / nullif(lag(v, 24, 0.0) OVER (ORDER BY h), 0) * 100 AS change_24
FROM (SELECT date_trunc('hour', ts) AS h, round(sum(value), 4) AS v FROM events GROUP BY 1) a"""


@query(f"""SELECT h, v, round(mean_12, 8) AS mean_12, round(mean_24, 8) AS mean_24, round(change_12, 6) AS change_12, round(change_24, 6) AS change_24,
coalesce(change_12 > 20, false) OR coalesce(change_24 > 20, false) AS alert FROM ({TREND}) t""")
def usage_trend_alert(spark, folder):
    hourly = load(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.round(F.sum("value"), 4).alias("v"))
    return costs.trend_alert(hourly, "v", ["h"]).select("h", "v", *(F.round(c, d).alias(c) for c, d in (("mean_12", 8), ("mean_24", 8), ("change_12", 6), ("change_24", 6))), "alert")


@query("""SELECT c_mktsegment, d, revenue, round(avg(revenue) OVER w, 3) AS mean, round(coalesce(stddev_samp(revenue) OVER w, 0), 3) AS deviation,
round(avg(revenue) OVER w - 2 * coalesce(stddev_samp(revenue) OVER w, 0), 3) AS lower, round(avg(revenue) OVER w + 2 * coalesce(stddev_samp(revenue) OVER w, 0), 3) AS upper
FROM (SELECT c_mktsegment, date_trunc('day', o_orderdate) AS d, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) x
WINDOW w AS (PARTITION BY c_mktsegment ORDER BY d ROWS BETWEEN 72 PRECEDING AND CURRENT ROW)""")
def rolling_bands(spark, folder):
    orders, customer = load(spark, folder, "orders"), load(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    daily = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_mktsegment", F.date_trunc("day", "o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return costs.bands(daily, "revenue", ["d"], 72, ["c_mktsegment"]).select("c_mktsegment", "d", "revenue", *(F.round(c, 3).alias(c) for c in ("mean", "deviation", "lower", "upper")))


@query("""SELECT p_partkey, revenue, round(revenue / sum(revenue) OVER (), 8) AS share, round(sum(revenue) OVER (ORDER BY revenue DESC, p_partkey) / sum(revenue) OVER (), 6) AS cumulative
FROM (SELECT l_partkey AS p_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1) x""")
def pareto_parts(spark, folder):
    sums = load(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double").alias("revenue"))
    return costs.pareto(sums, "revenue", "p_partkey").select("p_partkey", "revenue", F.round("share", 8).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS forward_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS backward_rank FROM orders""")
def scd_ranks(spark, folder):
    return costs.both_ranks(load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT t.event_type, t.n AS now, b.n AS before, round((t.n - b.n) * 100.0 / b.n, 4) AS growth FROM (SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1) t
LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) - 7 FROM events) GROUP BY 1) b USING (event_type)""")
def weekly_growth(spark, folder):
    daily = load(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    last = daily.agg(F.max("d")).first()[0]
    return costs.growth(daily, "d", F.lit(last), 7, ["event_type"], "n").withColumn("growth", F.round("growth", 4))


# --- profiles -----------------------------------------------------------------------------------------------------


@query("""SELECT n_name, orders, CAST(revenue AS DOUBLE) AS revenue, round(coalesce((orders - min(orders) OVER ()) / nullif(CAST(max(orders) OVER () - min(orders) OVER () AS DOUBLE), 0), 0), 6) AS "ordersScaled",
round(coalesce((revenue - min(revenue) OVER ()) / nullif(CAST(max(revenue) OVER () - min(revenue) OVER () AS DOUBLE), 0), 0), 6) AS "revenueScaled" FROM (SELECT n_name, count(*) AS orders,
CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) x""")
def minmax_scaled(spark, folder):
    o, c, n = (load(spark, folder, t) for t in ("orders", "customer", "nation"))
    sums = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("revenue"))
    return layout.min_max_scaled(sums, ["orders", "revenue"]).select("n_name", "orders", F.col("revenue").cast("double"), F.round("ordersScaled", 6).alias("ordersScaled"), F.round("revenueScaled", 6).alias("revenueScaled"))


@query("""WITH c AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS a, count(DISTINCT o_orderstatus) AS b, count(DISTINCT o_orderpriority) AS d, count(DISTINCT o_orderkey) AS e FROM orders)
SELECT column_name, distinct_count, row_count, round(distinct_count / CAST(row_count AS DOUBLE), 6) AS share FROM (SELECT 'o_custkey' AS column_name, a AS distinct_count, n AS row_count FROM c
UNION ALL SELECT 'o_orderstatus', b, n FROM c UNION ALL SELECT 'o_orderpriority', d, n FROM c UNION ALL SELECT 'o_orderkey', e, n FROM c) x""")
def cardinality_profile(spark, folder):
    return layout.cardinality(load(spark, folder, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"])


STATS = [
    ("orders", "o_custkey", 40, 5, 0.7, 2, 0.0667, 1000, 15000, False), ("orders", "o_orderkey", 90, 20, 1.0, 3, 1.0, 15000, 15000, False), ("orders", "o_orderstatus", 10, 0, 0.1, 1, 0.0002, 3, 15000, False),
    ("orders", "o_orderdate", 70, 1, 0.9, 1, 0.16, 2400, 15000, False), ("events", "user_id", 50, 9, 0.5, 2, 0.1, 1000, 10000, False), ("events", "ts", 80, 3, 0.8, 1, 0.99, 9900, 10000, False),
    ("events", "event_type", 30, 0, 0.3, 1, 0.0005, 5, 10000, True),
]
STATS_COLUMNS = "table_name string, column_name string, reads long, writes long, scaled_metrics double, role_flags long, share double, distinct_count long, row_count long, is_partition boolean"
_VALUES = ", ".join(f"('{a}', '{b}', {', '.join(str(x).lower() for x in rest)})" for a, b, *rest in STATS)


@query(f"""SELECT table_name, column_name, score, r AS "rank", ((r <= 2 AND distinct_count >= 1000) OR (share >= 0.2 AND distinct_count >= 1000) OR (share >= 0.01 AND row_count >= 1000000)) AS chosen FROM (SELECT *, rank() OVER (PARTITION BY table_name ORDER BY score DESC) AS r
FROM (SELECT *, round(CAST(reads AS DOUBLE) * (1 + scaled_metrics + role_flags) * (0.001 + share) + writes * (0.001 + share), 6) AS score FROM (VALUES {_VALUES}) v(table_name, column_name, reads, writes, scaled_metrics, role_flags, share, distinct_count, row_count, is_partition) WHERE NOT is_partition) a) b""")
def layout_score(spark, folder):
    return layout.layout_scores(spark.createDataFrame(STATS, STATS_COLUMNS)).select("table_name", "column_name", "score", "rank", "chosen")


@query("""SELECT o_orderkey, min(mb) AS target_mb FROM orders LEFT JOIN (VALUES (20000, 16), (60000, 32), (150000, 64), (300000, 128)) b(up_to, mb) ON CAST(o_totalprice AS BIGINT) <= up_to GROUP BY 1""")
def bucket_lookup(spark, folder):
    """The smallest band of each order; halves go to the even number, as casts of DuckDB round."""
    orders = load(spark, folder, "orders").select("o_orderkey", F.rint("o_totalprice").cast("long").alias("size"))
    bands = F.array(*(F.struct(F.lit(a).alias("up_to"), F.lit(b).alias("mb")) for a, b in ((20000, 16), (60000, 32), (150000, 64), (300000, 128))))
    found = orders.select("o_orderkey", F.array_min(F.transform(F.filter(bands, lambda x: F.col("size") <= x["up_to"]), lambda x: x["mb"])).alias("mb"))
    return found.groupBy("o_orderkey").agg(F.min("mb").alias("target_mb"))


# --- SQL that both engines read -----------------------------------------------------------------------------------

shared_sql("tpch_join_avg_qty", """SELECT n_name, round(avg(l_quantity), 4) AS avg_quantity, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' GROUP BY n_name""".replace("TIMESTAMP_NTZ", "TIMESTAMP"), """SELECT n_name, round(avg(l_quantity), 4) AS avg_quantity, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' GROUP BY n_name""")
shared_sql("tpch_order_totals", """SELECT r_name, o_orderpriority, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderpriority""")
shared_sql("star_join_using", """SELECT p_brand, s_name, sum(l_quantity) AS quantity FROM (SELECT l_partkey AS partkey, l_suppkey AS suppkey, l_quantity FROM lineitem) f
JOIN (SELECT p_partkey AS partkey, p_brand FROM part) p USING (partkey) JOIN (SELECT s_suppkey AS suppkey, s_name FROM supplier) s USING (suppkey) GROUP BY p_brand, s_name""")
shared_sql("anti_missing_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
shared_sql("not_exists_parts", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
shared_sql("semi_in_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
shared_sql("left_join_not_null", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 48 WHERE l_orderkey IS NOT NULL")
shared_sql("union_entities", """SELECT 'region' AS entity, CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(NULL AS DOUBLE) AS balance FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name, CAST(NULL AS DOUBLE) FROM nation
UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier""")
shared_sql("group_by_all", "SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL ORDER BY ALL")
shared_sql("count_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(count_if(value > 50) AS BIGINT) AS large FROM events GROUP BY user_id")
shared_sql("distinct_conditional_counts", """SELECT event_type, count(DISTINCT CASE WHEN value > 20 THEN user_id END) AS users_over, count(DISTINCT user_id) AS users,
round(count(DISTINCT CASE WHEN value > 20 THEN user_id END) / CAST(count(DISTINCT user_id) AS DOUBLE), 6) AS rate FROM events GROUP BY event_type""")
shared_sql("json_path_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1", "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
shared_sql("long_running", """SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.95) FROM events) ORDER BY value DESC, event_id LIMIT 100""",
           "SELECT event_id, value FROM events WHERE value > (SELECT percentile(value, 0.95) FROM events) ORDER BY value DESC, event_id LIMIT 100")
shared_sql("group_share", """SELECT event_id, round(value / sum(value) OVER (), 8) AS share, round(avg(value) OVER (PARTITION BY event_type), 6) AS type_mean FROM (SELECT event_id, event_type, round(value, 2) AS value FROM events) e""",
           """WITH e AS (SELECT event_id, event_type, round(value, 2) AS value FROM events), g AS (SELECT event_type, avg(value) AS type_mean FROM e GROUP BY event_type)
SELECT event_id, round(value / total, 8) AS share, round(type_mean, 6) AS type_mean FROM e JOIN g USING (event_type) CROSS JOIN (SELECT sum(value) AS total FROM e) t""")
shared_sql("rolling_week_from_max", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
shared_sql("lateral_alias", """SELECT o_orderkey, o_totalprice / 100 AS hundred, o_totalprice / 100 * 1.19 AS gross FROM orders""", "SELECT o_orderkey, o_totalprice / 100 AS hundred, hundred * 1.19D AS gross FROM orders")
shared_sql("select_except", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer", "SELECT * EXCEPT (c_name, c_acctbal) FROM customer")
shared_sql("top_usage", "SELECT c_mktsegment, o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY cents DESC, o_custkey LIMIT 20")
shared_sql("daily_rates", "SELECT event_type, round(sum(round(value, 2)) / count(DISTINCT date_trunc('day', ts)), 4) AS value_a_day, round(count(*) / CAST(count(DISTINCT date_trunc('day', ts)) AS DOUBLE), 4) AS events_a_day FROM events GROUP BY event_type")
shared_sql("name_parts", """SELECT c_custkey, upper(split_part(c_name, '#', 1)) AS kind, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS padded, replace(c_name, '#', '-') AS dashed, length(c_name) AS n FROM customer""",
           "SELECT c_custkey, upper(split_part(c_name, '#', 1)) AS kind, lpad(CAST(c_custkey AS STRING), 9, '0') AS padded, replace(c_name, '#', '-') AS dashed, CAST(length(c_name) AS BIGINT) AS n FROM customer")
shared_sql("collected_sets", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id", "SELECT user_id, array_join(sort_array(collect_set(event_type)), ',') AS types FROM events GROUP BY user_id")
shared_sql("literal_join_budget", """SELECT h, v, v > budget AS over_budget FROM (SELECT date_trunc('hour', ts) AS h, round(sum(value), 2) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1) x LEFT JOIN (VALUES ('purchase', 100.0), ('view', 50.0)) b(sku, budget) ON b.sku = 'purchase'""",
           "SELECT h, v, v > budget AS over_budget FROM (SELECT date_trunc('hour', ts) AS h, round(sum(value), 2) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1) x LEFT JOIN (SELECT * FROM VALUES ('purchase', 100.0D), ('view', 50.0D) AS b(sku, budget)) b ON b.sku = 'purchase'")
