import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import expressions as fx
from siltstone.operators import access, dedup, graph, intervals, layout, merge, validate
from siltstone.operators.runlog import EPOCH, FAIL, SUCCESS, RunLog, TempTables, with_keys
from siltstone.operators.snapshots import Snapshots
from siltstone.sources import catalog, files, paged
from siltstone.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- merges -------------------------------------------------------------------------------------------------------


def base(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "id int, v string, n int")


def test_merge_clauses_in_order(spark):
    source = spark.createDataFrame([(1, "x", 5), (2, "y", 0), (4, "z", 1), (5, "w", 0)], "id int, v string, n int")
    got = merge.merge(base(spark), source, ["id"], [merge.When("delete", merge.s("n") == 0), merge.When("update", None, skip=("n",)), merge.When("insert", merge.s("n") > 0)])
    assert rows(got) == [(1, "x", 1), (3, None, 1), (4, "z", 1)]


def test_merge_refuses_two_matches(spark):
    twice = spark.createDataFrame([(1, "x", 5), (1, "y", 6)], "id int, v string, n int")
    with pytest.raises(Exception, match="several source rows"):
        merge.merge(base(spark), twice, ["id"], [merge.When("update")]).collect()
    # without a clause for them, rows that match twice stay once
    assert rows(merge.merge(base(spark), twice, ["id"], [merge.When("insert")])) == rows(base(spark))


def test_merge_null_keys_never_match(spark):
    t = spark.createDataFrame([(None, "a")], "id int, v string")
    assert rows(merge.merge(t, t, ["id"], [merge.When("update"), merge.When("insert")])) == [(None, "a"), (None, "a")]


def test_merge_evolves(spark):
    source = spark.createDataFrame([(1, "x", 9.5)], "id int, v string, more double")
    got = merge.merge(base(spark), source, ["id"], [merge.When("update")], evolve=True)
    assert got.columns == ["id", "v", "n", "more"] and rows(got)[0] == (1, "x", 1, 9.5)


def test_late_changes(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id int, v string, at int")
    changes = spark.createDataFrame([(1, "old", 5, "update_postimage"), (2, "b", 12, "delete"), (3, "c", 1, "insert"), (4, "d", 1, "delete"), (3, "cc", 2, "update_postimage")], "id int, v string, at int, _change_type string")
    assert rows(merge.merge_changes(target, changes, ["id"], "at")) == [(1, "a", 10), (3, "cc", 2)]
    assert rows(merge.merge_changes(target, changes, ["id"], "at", late="insert")) == [(1, "a", 10), (1, "old", 5), (3, "cc", 2)]


def test_change_feed_replays(spark):
    after = spark.createDataFrame([(1, "a", 2), (3, None, 1), (7, "n", 1)], "id int, v string, n int")
    changes = merge.changes_between(base(spark), after, ["id"])
    assert sorted(r[3] for r in rows(changes)) == ["delete", "insert", "update_postimage", "update_preimage"]
    assert rows(merge.replay(base(spark), changes.withColumn("_commit_version", F.lit(1)), ["id"])) == rows(after)


def scd(spark, rows_):
    return spark.createDataFrame(rows_, "id int, v string, at int")


def history(spark):
    return spark.createDataFrame([], "id int, v string, at int, start_time int, end_time int, is_current boolean")


def test_scd2(spark):
    first = merge.scd2_merge(history(spark), scd(spark, [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, None, 1)]), ["id"], "at")
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in rows(first)] == [(1, "a", 1, 3, False), (1, "b", 3, None, True), (2, None, 1, None, True)]
    second = merge.scd2_merge(first, scd(spark, [(1, "late", 2), (1, "c", 9), (2, "x", 4), (3, "n", 1)]), ["id"], "at")
    got = sorted(((r[0], r[1], r[3], r[4]) for r in rows(second)), key=lambda r: (r[0], r[2]))
    assert got == [(1, "a", 1, 3), (1, "b", 3, 9), (1, "c", 9, None), (2, None, 1, 4), (2, "x", 4, None), (3, "n", 1, None)]
    unsafe = merge.scd2_merge(first, scd(spark, [(2, "x", 4)]), ["id"], "at", null_safe=False)
    assert (2, None, None) in [(r[0], r[1], r[4]) for r in rows(unsafe)]
    again = merge.scd2_merge(second, scd(spark, [(1, "c", 9), (2, "x", 4)]), ["id"], "at")
    assert rows(again) == rows(second)


def test_apply_changes_out_of_order(spark):
    t = merge.apply_changes(scd(spark, []), scd(spark, [(1, "b", 2), (1, "a", 1), (2, "gone", 3)]), ["id"], "at", F.col("v") == "gone")
    assert rows(t) == [(1, "b", 2)]
    assert rows(merge.apply_changes(t, scd(spark, [(1, "a", 1)]), ["id"], "at")) == [(1, "b", 2)]


def test_upsert_is_idempotent(spark):
    s = spark.createDataFrame([(2, "n", 9), (8, "m", 9)], "id int, v string, n int")
    once = merge.upsert(base(spark), s, ["id"])
    assert rows(merge.upsert(once, s, ["id"])) == rows(once)


# --- versions, logs, files ------------------------------------------------------------------------------------------


def test_snapshots(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t")
    assert t.latest() is None and t.write(base(spark)) == 0
    t.write(t.read().where("id > 1"))
    assert t.read(0).count() == 3 and t.read().count() == 2
    with pytest.raises(ZeroDivisionError):
        t.guarded(lambda x: (x.write(x.read().limit(0)), 1 / 0))
    assert t.versions() == [0, 1]
    t.restore(0)
    assert rows(t.read()) == rows(base(spark)) and [r["operation"] for r in t.history().collect()][-1] == "restore 0"
    assert t.publish("good", [lambda df: F.count("*") == 2]) == 1 and spark.table("good").count() == 2
    with pytest.raises(ValueError):
        t.publish("good", [lambda df: F.count("*") == 99])
    assert rows(t.clone(f"file://{tmp_path}/u", 1).read()) == rows(t.read(1))
    assert t.vacuum(1) == [0, 1] and t.versions() == [2]
    with pytest.raises(ValueError):
        t.read(0)


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.watermark("p") == EPOCH
    a = log.start("p")
    with pytest.raises(RuntimeError):
        log.start("p")
    log.note(a, "half way", rows=5)
    log.finish(a, SUCCESS, metrics={"rows": 7})
    b = log.start("p")
    log.finish(b, FAIL, "no luck")
    assert log.last("p")["run_id"] == b and log.last("p", SUCCESS)["metrics"] == '{"rows": 7}' and log.last("p", FAIL)["notes"][0]["note"] == "no luck"
    assert log.watermark("p", FAIL) > log.watermark("p", SUCCESS) > EPOCH
    c = log.start("q")
    assert log.clean(dt.datetime(2999, 1, 1)) == [c] and log.last("q")["status"] == "STALE"
    with pytest.raises(ValueError):
        log.finish(a, "FAILED")


def test_temp_tables_and_keys(spark, tmp_path):
    t = TempTables(spark, str(tmp_path))
    t.save("x", base(spark))
    assert t.save("x", base(spark), append=True).count() == 6 and t.drop("x") and not t.drop("x")
    assert rows(with_keys(base(spark), "k", 10, ["id"]).select("id", "k")) == [(1, 11), (2, 12), (3, 13)]


def test_copy_into(spark, tmp_path):
    src, to = tmp_path / "in", str(tmp_path / "t")
    src.mkdir()
    (src / "a.csv").write_text("id,v\n1,x\n")
    load = lambda **o: files.copy_into(spark, str(src), to, "csv", header=True, glob="*.csv", **o)
    assert (load(), load()) == (1, 0)
    (src / "b.csv").write_text("id,v,w\n2,y,z\n")
    with pytest.raises(ValueError):
        load()
    assert load(merge_schema=True) == 1 and sorted(files.loaded(spark, to).columns) == ["id", "v", "w"]
    assert load(force=True, merge_schema=True) == 2 and files.loaded(spark, to).count() == 4
    (src / "p.txt").write_text("1|a\n2|b\n")
    assert rows(files.by_position(spark, str(src / "p.txt"), "k int, s string", sep="|", modified=None)) == [(1, "a"), (2, "b")]
    listed = files.listing(spark, f"file://{src}")
    assert listed.count() == 3 and files.folder_sizes(listed).where(F.col("folder").endswith("/in")).first()["files"] == 3
    moved = spark.createDataFrame([(str(src / "p.txt"), str(tmp_path / "out" / "q.txt")), (str(src / "none"), str(tmp_path / "n"))], "source string, destination string")
    assert [r[2][:4] for r in rows(files.move_files(moved))] == ["FAIL", "SUCC"] and (tmp_path / "out" / "q.txt").exists()


def test_stream_restarts_from_checkpoint(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "part-1.json").write_text('{"id": 1, "n": {"x": "a"}}\n')
    run = lambda: streams.drain(streams.json_path_stream(spark, str(src), {"id": ("$.id", "int"), "x": ("$.n.x", "string")}, "part-*.json").select("id", "x"), str(tmp_path / "c"), str(tmp_path / "o"))
    run()
    (src / "part-2.json").write_text('{"id": 2}\n')
    (src / "other.json").write_text('{"id": 3}\n')
    run()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == [(1, "a"), (2, None)]


def test_version_checkpoint_and_placing(spark, tmp_path):
    c = streams.VersionCheckpoint(spark, str(tmp_path / "c"))
    assert c.get() == -1 and c.advance(3) and not c.advance(3) and c.get() == 3
    jobs = spark.createDataFrame([("j1", ["a", "b"])], "job_name string, event_names array<string>")
    new = spark.createDataFrame([(x,) for x in "abcdefghij"], "event_name string")
    placed = rows(streams.place_streams(jobs, new, most=4))
    assert len(placed) == 8 and sum(r[1] == "j1" for r in placed) == 2 and {r[1] for r in placed if r[2]} == {"new_job_1", "new_job_2"}


# --- functions, validation, graphs, layout ------------------------------------------------------------------------------


def test_expressions(spark):
    df = spark.createDataFrame([("DOE,JOHN M", "select 1 /* QUERY_TAG=etl */", "a.B")], "n string, q string, t string")
    parts = fx.person_name(F.col("n"))
    assert tuple(df.select(parts["last_name"], parts["first_name"], parts["middle_name"], fx.query_tag(F.col("q")), fx.qualified_name(F.col("t")), fx.occurrences(F.col("q"), F.lit("e"))).first()) == ("DOE", "JOHN", "M", "etl", "spark_catalog.a.b", 3)
    kinds = spark.createDataFrame([("SELECT",), ("READ_VOLUME",), ("READXVOLUME",), ("CREATE TABLE",), (None,)], "p string").select(fx.access_kind(F.col("p")))
    assert [r[0] for r in kinds.collect()] == ["Read", "Read", "Unknown", "Edit", "Unknown"]
    fx.register(spark)
    assert spark.sql("SELECT query_tag('x -- QUERY_TAG: a1'), query_tag('x'), safe_ratio(1D, 0D), epoch_time(5)").first()[:3] == ("a1", "UNTAGGED", 0.0)
    assert fx.statements("a; b 'x;y' -- c;d\n; /* ; */ e") == ["a", "b 'x;y' -- c;d", "/* ; */ e"]
    assert fx.inline_views("select * from V join vv", {"v": "select 1"}) == "select * from (select 1) join vv"
    perms = spark.createDataFrame([("me", 1)], "user_name string, id int")
    assert fx.visible_rows(base(spark), perms, "me", ["id"]).count() == 1
    assert fx.masked(base(spark), ["v"]).first()["v"] == "x"


def test_row_hash_separator(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(validate.row_hash(["x", "y"])).distinct().count() == 4
    assert df.select(validate.row_hash(["x", "y"], separator=None, nulls="")).distinct().count() == 1
    got = validate.compare(df.unionByName(df), df).first()
    assert (got["original_rows"], got["other_rows"], got["matched_rows"]) == (8, 4, 4)
    assert validate.compare(df.unionByName(df), df, mode="left").first()["matched_rows"] == 8


def test_graph(spark):
    nodes = spark.createDataFrame([(x, "t" if x in "ab" else "u") for x in "abcde"], "id string, type string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "r")], "src string, dst string, relationship_type string")
    paths = {(r["node"], r["level"], r["path"]) for r in graph.simple_paths(nodes, edges, "a", 3).collect()}
    assert paths == {("b", 1, "a, b"), ("c", 1, "a, c"), ("c", 2, "a, b, c"), ("b", 2, "a, c, b"), ("d", 2, "a, c, d"), ("d", 3, "a, b, c, d")}
    assert [r["id"] for r in graph.top_connected(nodes, edges, 2, ["u"]).orderBy("rank").collect()] == ["c", "d"]
    scores = {r["id"]: r["score"] for r in graph.pagerank(nodes, edges, rounds=40).collect()}
    assert max(scores, key=scores.get) in "abc" and scores["e"] < scores["d"]
    assert rows(graph.edges_touching(edges, spark.createDataFrame([("d",), ("b",)], "id string")))[0][:2] == ("a", "b")
    docs = catalog.synthetic_graph(spark, 6, 4)
    n, e = graph.split_documents(docs)
    assert (n.count(), e.count()) == (6, 4) and graph.relationship_types(e) == ["uses"] and graph.node_types(n) == ["identity", "indicator", "malware"]
    assert graph.read_only(" WITH x AS (select 1) select 1;") and not graph.read_only("select 1; drop table x") and not graph.read_only("delete from x")


def test_concurrency(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([(t(0), t(10)), (t(5), t(15)), (t(10), t(20)), (t(12), None)], "s timestamp, e timestamp")
    levels = {r["level"]: r["seconds"] for r in intervals.concurrency_levels(df, "s", "e", F.lit(t(0)), F.lit(t(30))).collect()}
    assert levels == {1: 15.0, 2: 12.0, 3: 3.0}
    q = intervals.concurrency_quantiles(intervals.concurrency_levels(df, "s", "e", F.lit(t(0)), F.lit(t(30)))).first()
    assert (q["p50"], q["p90"], q["p100"]) == (1, 2, 3)
    assert [intervals.look_back_minutes(x, 1) for x in (None, 1, 100, 5000)] == [30.0, 30.0, 210, 1440.0]


def test_layout(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 64).alias("a"), (F.col("id") * 7 % 61).alias("b"))
    layout.clustered(df, ["a", "b"], bits=3, files=16).write.parquet(str(tmp_path / "z"))
    ranges = spark.read.parquet(str(tmp_path / "z")).groupBy(F.col("_metadata.file_name")).agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b"))
    assert ranges.agg(F.avg("a"), F.avg("b")).first()[0] < 40 and layout.clustered(df, ["a"]).count() == 4000
    sizes = spark.createDataFrame([("t", 5 << 30), ("u", 200 << 30)], "table_name string, size_bytes long")
    scores = layout.layout_scores(spark.createDataFrame([("t", "k", 5, 5, 0.5, 1, 0.9, 5000, 9000, False)], "table_name string, column_name string, reads long, writes long, scaled_metrics double, role_flags long, share double, distinct_count long, row_count long, is_partition boolean"))
    said = {r["table_name"]: r for r in layout.commands(scores, sizes).collect()}
    assert said["t"]["optimize"] == "OPTIMIZE t ZORDER BY (k)" and said["u"]["optimize"] == "OPTIMIZE u" and "'128'" in said["u"]["properties"]
    assert rows(layout.cardinality(base(spark), ["v"])) == [("v", 2, 3, 0.666667)]


def test_access(spark):
    objects = spark.createDataFrame([("c.s.t",), ("c.x.t",)], "full_name string")
    tags = spark.createDataFrame([("c", "env", "prod"), ("c.s", "pii", "yes")], "full_name string, tag_name string, tag_value string")
    assert rows(access.inherited_tags(objects, tags)) == [("c.s.t", ["env=prod", "pii=yes"]), ("c.x.t", ["env=prod"])]
    grants = access.privileges({"TABLE": spark.createDataFrame([("c", "s", "t", "t", "x", "g", "SELECT", None)], "catalog_name string, schema_name string, table_name string, object_name string, grantor string, grantee string, privilege_type string, inherited_from string"),
                                "CATALOG": spark.createDataFrame([("c", "x", "u", "MODIFY")], "catalog_name string, grantor string, grantee string, privilege_type string")})
    members = spark.createDataFrame([("u", "g"), ("v", "g")], "user_name string, group_name string")
    assert sorted((r["user_name"], r["access"], r["through"]) for r in access.effective(grants, members).collect()) == [("u", "Edit", "user"), ("u", "Read", "g"), ("v", "Read", "g")]
    lineage = spark.createDataFrame([("a", "b"), ("b", "c")], "source_table_full_name string, target_table_full_name string")
    assert rows(access.related_objects(lineage, spark.createDataFrame([("a",)], "full_name string"), "b")) == [("downstream", "c", False), ("upstream", "a", True)]


def test_paged_sources(spark):
    data = [{"id": i} for i in range(7)]

    def fetch(filters, token):
        at = int(token or 0)
        return data[at : at + 3], str(at + 3) if at + 3 < len(data) else None

    assert [r["id"] for r in paged.pages(fetch, {})] == list(range(7))
    assert paged.paged_table(spark, fetch, "id long", [{"w": 1}, {"w": 2}]).count() == 14
    assert len(list(paged.offset_pages(lambda a, n: data[a : a + n], 3))) == 7
    got = paged.statement_result(spark, [["1", "x"], [None, "y"], ["z", "w"]], base(spark).select("id", "v").schema)
    assert rows(got) == [(1, "x"), (None, "w"), (None, "y")]
    said = paged.run_script(spark, "SELECT 1; SELECT nope; SELECT 2", retries=1, wait=lambda s: None)
    assert [r["status"] for r in said] == ["SUCCEEDED", "FAILED"]
    assert [str(x) for x in paged.in_parallel([1, 0], lambda x: 1 // x)][0] == "1"


def test_migration_scripts(spark):
    tables = spark.createDataFrame([("s", "v", "VIEW", None, "select 1"), ("s", "w", "VIEW", None, "select 2"), ("s", "e", "EXTERNAL", "/mnt/a/e", None), ("s", "m", "MANAGED", "x", None)], "schema_name string, table_name string, class string, location string, view_text string")
    got = {r["table_name"]: r["statement"] for r in catalog.migration_scripts(tables, "new", {"/mnt/a": "s3://b"}).collect()}
    assert got == {"v": "CREATE OR REPLACE VIEW new.s.v AS select 1", "w": "CREATE OR REPLACE VIEW new.s.w AS select 2", "e": "CREATE TABLE IF NOT EXISTS new.s.e LIKE s.e LOCATION 's3://b/e'", "m": "CREATE TABLE IF NOT EXISTS new.s.m AS SELECT * FROM s.m"}


def test_dedup_ties(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, None, 9), (2, None, 1)], "k int, t int, tie int")
    assert rows(dedup.latest(df, ["k"], "t", "tie")) == [(1, 5, 2), (2, None, 1)]
