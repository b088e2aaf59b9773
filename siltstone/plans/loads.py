"""Queries that load, insert, refresh and merge; parameters, variables and scripts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import layout, merge
from ..operators.runlog import RunLog
from ..registry import query
from ..session import load, views
from ..sources import files, paged
from ..sources.catalog import describe
from .pipelines import _folder

# --- tables ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, CASE WHEN year(o_orderdate) < 1999 THEN o_orderstatus END AS o_orderstatus FROM orders")
def insert_by_name(spark, folder):
    """A table saved, appended to, and filled by INSERT ... BY NAME from a WITH query; columns it lacks are null."""
    name, at = f"siltstone_{uuid.uuid4().hex}", _folder(spark)
    views(spark, folder, "orders")
    rows = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    for part in ("year(o_orderdate) < 1997", "year(o_orderdate) BETWEEN 1997 AND 1998"):
        rows.where(part).drop("o_orderdate").write.mode("append").option("path", at).saveAsTable(name)
    late = "SELECT o_custkey, o_orderkey FROM orders WHERE year(o_orderdate) >= 1999"
    spark.sql(f"WITH late AS ({late}) INSERT INTO IDENTIFIER('{name}') BY NAME SELECT * FROM late")
    return spark.table(name)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice < 5000)""")
def update_delete(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = merge.updated(orders, {"o_orderstatus": F.lit("X")}, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000))
    return merge.deleted(changed, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 5000)).drop("o_totalprice")


@query("""SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, 'batch 7' AS batch FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY 1""")
def parameters_and_variables(spark, folder):
    """Named parameters, a table name as a parameter, and session variables, one of them set from a query. Variables are read
    when the query is run, so they have names of their own."""
    views(spark, folder, "orders")
    price, batch = (f"{name}_{uuid.uuid4().hex}" for name in ("least_price", "batch"))
    spark.sql(f"DECLARE VARIABLE {price} DOUBLE")
    spark.sql(f"SET VAR {price} = (SELECT avg(o_totalprice) FROM IDENTIFIER(:name))", args={"name": "orders"})
    spark.sql(f"DECLARE VARIABLE {batch} STRUCT<id: INT, note: STRING> = named_struct('id', 7, 'note', 'batch')")
    text = f"SELECT o_orderpriority, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, concat({batch}.note, ' ', {batch}.id) AS batch FROM IDENTIFIER(:name) WHERE o_orderstatus = :status AND o_totalprice > {price} GROUP BY 1"
    return spark.sql(text, args={"name": "orders", "status": "F"})


# --- configuration ----------------------------------------------------------------------------------------------------


@query("""SELECT 'silver_orders' AS table_name, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS checksum FROM orders UNION ALL SELECT 'silver_customer', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer""")
def config_driven_ingest(spark, folder):
    """Tasks from a JSON configuration load delimited files by position into bronze and silver tables, twice."""
    at = _folder(spark)
    load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.option("sep", "|").csv(f"{at}/raw/orders")
    load(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey").write.option("sep", "|").csv(f"{at}/raw/customer")
    rows = [
        (2, "orders", "csv", "o_orderkey long, o_custkey long, o_orderstatus string", "|", False, "bronze_orders", "silver_orders", "o_orderkey"),
        (1, "customer", "csv", "c_custkey long, c_name string, c_nationkey int", "|", False, "bronze_customer", "silver_customer", "c_custkey"),
    ]
    # fixed values: the names of the configuration's columns
    names = "task_id int, src_path string, src_format string, src_column_list string, src_sep string, src_header boolean, bronze_table string, silver_table string, primary_key string"
    spark.createDataFrame(rows, names).coalesce(1).write.json(f"{at}/config")
    tasks = spark.read.schema(names).json(f"{at}/config")
    first, again = (files.ingest_tasks(spark, tasks, f"{at}/raw", f"{at}/t") for _ in range(2))
    assert all(x["files"] > 0 for x in first) and all(x["files"] == 0 for x in again)
    sums = [spark.read.parquet(x["silver"]).agg(F.count("*").alias("n"), F.sum(c).alias("checksum")).select(F.lit(t).alias("table_name"), "n", "checksum") for x, t, c in zip(first, ("silver_customer", "silver_orders"), ("c_nationkey", "o_custkey"))]
    return sums[0].unionByName(sums[1])


@query("SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def script_graph(spark, folder):
    """Three scripts; the last one comes after the other two."""
    views(spark, folder, "orders", "customer")
    n = uuid.uuid4().hex
    scripts = {
        "report": f"CREATE OR REPLACE TEMPORARY VIEW report_{n} AS SELECT c_mktsegment, count(*) AS orders FROM a_{n} JOIN b_{n} ON o_custkey = c_custkey GROUP BY 1;",
        "a": f"CREATE OR REPLACE TEMPORARY VIEW a_{n} AS SELECT o_custkey FROM orders; -- first; of two",
        "b": f"CREATE OR REPLACE TEMPORARY VIEW b_{n} AS SELECT c_custkey, c_mktsegment FROM customer",
    }
    said = paged.run_graph(spark, scripts, {"report": ["a", "b"]})
    assert all(x["status"] == "SUCCEEDED" for run in said.values() for x in run), said
    return spark.table(f"report_{n}")


@query("""SELECT 'load' AS process_name, 'SUCCESS' AS status, 2 AS runs, true AS waits UNION ALL SELECT 'report', 'FAIL', 1, true""")
def run_log(spark, folder):
    """Runs that start, end and are counted by process and latest status; a second run at once is refused."""
    log = RunLog(spark, f"{_folder(spark)}/log")
    for name, status in (("load", "SUCCESS"), ("load", "SUCCESS"), ("report", "FAIL")):
        run = log.start(name)
        try:
            log.start(name)
            refused = False
        except RuntimeError:
            refused = True
        assert refused
        log.finish(run, status, metrics={"rows": 5})
    return log.runs().groupBy("process_name").agg(F.max_by("status", "start_time").alias("status"), F.count("*").cast("int").alias("runs"), F.min(F.col("end_time") >= F.col("start_time")).alias("waits"))


# --- refresh and feeds ------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, 'incremental' AS how FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1
UNION ALL SELECT o_custkey, o_orderkey, 'full' FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1""")
def refresh_full_and_incremental(spark, folder):
    """A first copy, then newer rows alone; a target with other columns falls back to a full copy."""
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey")
    middle = orders.agg(F.percentile_approx("o_orderkey", 0.5)).first()[0]
    first, how = merge.refreshed(None, orders.where(F.col("o_orderkey") <= middle), ["o_custkey"], "o_orderkey")
    assert how == "full"
    after, how_after = merge.refreshed(first, orders, ["o_custkey"], "o_orderkey")
    other, how_other = merge.refreshed(first.drop("o_orderkey"), orders, ["o_custkey"], "o_orderkey")
    return after.withColumn("how", F.lit(how_after)).unionByName(other.withColumn("how", F.lit(how_other)))


@query("""SELECT o_custkey, last_key, CAST(v AS BIGINT) AS _src_commit_version FROM (SELECT o_custkey, max(o_orderkey) AS last_key, 2 AS v FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1
UNION ALL SELECT o_custkey, max(o_orderkey), 1 FROM orders WHERE year(o_orderdate) < 1998 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 1998) GROUP BY 1) x""")
def merge_from_feed(spark, folder):
    """A change feed of two versions merged in two steps; the second reads only what the target has not seen."""
    orders = load(spark, folder, "orders")
    kind = {1: "insert", 2: "update_postimage"}
    at = {1: F.lit("2024-01-01 00:00:00"), 2: F.lit("2024-01-02 00:00:00")}
    part = {1: "year(o_orderdate) < 1998", 2: "year(o_orderdate) >= 1998"}
    versions = [orders.where(part[v]).groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_key")).select("o_custkey", "last_key", at[v].cast("timestamp").alias("changed_at"), F.lit(kind[v]).alias("_change_type"), F.lit(v).cast("long").alias("_commit_version")) for v in (1, 2)]
    empty = versions[0].limit(0).select("o_custkey", "last_key", "changed_at", F.col("_commit_version").alias("_src_commit_version"))
    once = merge.merge_feed(empty, versions[0], ["o_custkey"], "changed_at")
    return merge.merge_feed(once, versions[0].unionByName(versions[1]), ["o_custkey"], "changed_at").drop("changed_at")


@query("""SELECT o_custkey, o_orderstatus, n, note FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, CAST(NULL AS VARCHAR) AS note FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1, 2) t
WHERE (o_custkey, o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE year(o_orderdate) >= 1998) UNION ALL SELECT o_custkey, o_orderstatus, count(*), 'late' FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1, 2""")
def merge_evolves(spark, folder):
    """The source's new column is added to the target."""
    orders = load(spark, folder, "orders")
    keys = ["o_custkey", "o_orderstatus"]
    target = orders.where("year(o_orderdate) < 1998").groupBy(*keys).agg(F.count("*").alias("n"))
    source = orders.where("year(o_orderdate) >= 1998").groupBy(*keys).agg(F.count("*").alias("n"), F.lit("late").alias("note"))
    return merge.merge(target, source, keys, [merge.When("update"), merge.When("insert")], evolve=True)


@query("""WITH t AS (SELECT o_custkey, max(o_orderdate) AS seen, 'old' AS state FROM orders WHERE year(o_orderdate) < 1999 GROUP BY 1), s AS (SELECT o_custkey, max(o_orderdate) AS seen, 'new' AS state FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1)
SELECT t.o_custkey, CASE WHEN s.o_custkey IS NOT NULL AND year(t.seen) >= 1997 THEN s.seen ELSE t.seen END AS seen, CASE WHEN s.o_custkey IS NOT NULL AND year(t.seen) >= 1997 THEN 'new' ELSE 'old' END AS state FROM t LEFT JOIN s ON t.o_custkey = s.o_custkey
UNION ALL SELECT s.o_custkey, s.seen, s.state FROM s LEFT JOIN t ON t.o_custkey = s.o_custkey AND year(t.seen) >= 1997 WHERE t.o_custkey IS NULL""")
def merge_within_time(spark, folder):
    """A target bound in the match: rows from before it are not touched, and their keys are inserted anew."""
    orders = load(spark, folder, "orders")
    sides = [orders.where(p).groupBy("o_custkey").agg(F.max("o_orderdate").alias("seen"), F.lit(s).alias("state")) for p, s in (("year(o_orderdate) < 1999", "old"), ("year(o_orderdate) >= 1999", "new"))]
    return merge.merge(*sides, ["o_custkey"], [merge.When("update"), merge.When("insert")], on=F.year(merge.t("seen")) >= 1997)


@query("""WITH t AS (SELECT o_custkey, min(o_orderdate) AS at, 'first' AS note FROM orders GROUP BY 1), s AS (SELECT o_custkey, min(o_orderdate) AS at, 'F' AS note FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT t.o_custkey, CASE WHEN s.at > t.at THEN s.at ELSE t.at END AS at, CASE WHEN s.at > t.at THEN 'F' ELSE 'first' END AS note FROM t LEFT JOIN s USING (o_custkey)
UNION ALL SELECT s.o_custkey, s.at, s.note FROM s JOIN t USING (o_custkey) WHERE NOT s.at > t.at""")
def merge_late_inserts(spark, folder):
    """A change that is not newer than its row is added as a second one (`late="insert"`)."""
    orders = load(spark, folder, "orders")
    target = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("at"), F.lit("first").alias("note"))
    changes = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("at"), F.lit("F").alias("note"), F.lit(merge.AFTER).alias("_change_type"))
    return merge.merge_changes(target, changes, ["o_custkey"], "at", late="insert")


@query("""SELECT k, n, kind AS _change_type FROM (SELECT CAST(NULL AS BIGINT) AS k, 1 AS n, '' AS kind WHERE false UNION ALL SELECT o_custkey, 2, 'update_postimage' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a
UNION ALL SELECT o_custkey, 1, 'update_preimage' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') b) x""")
def change_feed_null_keys(spark, folder):
    """A null key is a value like others: a row that did not change gives no change row."""
    custkeys = load(spark, folder, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus").groupBy("k").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    none = spark.createDataFrame([(None, 1)], "k long, n int")
    before = custkeys.select("k", F.lit(1).alias("n")).unionByName(none)
    after = custkeys.select("k", F.when(F.col("f") == 1, 2).otherwise(1).alias("n")).unionByName(none)
    return merge.changes_between(before, after, ["k"])


# fixed values: table sizes in GB and file sizes in MB, as in layout.FILE_SIZES
@query("""SELECT key, mb AS target_mb FROM (SELECT o_orderkey AS key, CAST(o_totalprice * 20 AS BIGINT) AS gb FROM orders) o LEFT JOIN LATERAL (SELECT min(mb) AS mb FROM (VALUES (8, 16), (16, 32), (32, 64), (64, 64), (128, 128), (256, 128), (512, 256), (1024, 256), (2560, 512), (3072, 716), (5120, 1024), (7168, 1024), (10240, 1024),
(51200, 1024), (102400, 1024), (204800, 1024), (409600, 1024), (819200, 1024), (1638400, 2048)) b(up_to, mb) WHERE o.gb <= up_to) m ON true""")
def file_size_bands(spark, folder):
    """Target file sizes of tables of as many GB as twenty times an order's price."""
    size = F.col("gb") * F.lit(layout.GB)
    return load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") * 20).cast("long").alias("gb")).select("key", layout.file_size_mb(size).alias("target_mb"))


@query("SELECT event_id, user_id FROM events ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id LIMIT 100")
def seeded_sample(spark, folder):
    return layout.sample_rows(load(spark, folder, "events").select("event_id", "user_id"), 100, "event_id", 7)


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def csv_merge_schema(spark, folder):
    """Two folders of delimited files into one table; the second one has a column more."""
    at = _folder(spark)
    orders = load(spark, folder, "orders")
    old, new = orders.where("year(o_orderdate) < 1998").select("o_orderkey", "o_orderstatus"), orders.where("year(o_orderdate) >= 1998").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    for name, part in (("a", old), ("b", new)):
        part.write.option("header", "true").csv(f"{at}/{name}")
        files.copy_into(spark, f"{at}/{name}", f"{at}/t", "csv", schema=part.schema, merge_schema=True, header=True)
    return files.loaded(spark, f"{at}/t").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS known_rows FROM orders GROUP BY 1")
def create_as_select(spark, folder):
    """A table made from a query, made anew by another one, and its row count from ANALYZE."""
    name, at = f"siltstone_{uuid.uuid4().hex}", _folder(spark)
    views(spark, folder, "orders")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{at}/a' AS SELECT o_orderkey FROM orders")
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{at}/b' AS SELECT o_orderkey, o_orderstatus FROM orders")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    known = int(describe(spark, name)["Statistics"].split(", ")[1].split(" ")[0])
    return spark.table(name).groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("known_rows", F.lit(known).cast("long"))


@query("SELECT 'part-' AS kind, 3 AS files, true AS has_bytes")
def folder_listing(spark, folder):
    """The files of a folder, without reading them."""
    at = _folder(spark)
    for i in range(3):
        load(spark, folder, "nation").coalesce(1).write.mode("append").parquet(f"{at}/sub/k={i}")
    found = files.listing(spark, at, "*.parquet")
    return found.groupBy(F.substring("file_name", 1, 5).alias("kind")).agg(F.count("*").cast("int").alias("files"), F.min(F.col("file_size") > 0).alias("has_bytes"))
