import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.operators import profile
from siltstone.streaming import sinks


def test_column_roles(spark):
    q = spark.createDataFrame([("a", "SELECT x FROM s.t JOIN u ON t.k = u.k WHERE x > 1 GROUP BY y ORDER BY z", 2, 10.0), ("b", "select 1 from u where x = 2", 1, 5.0)], "query_hash string, query_text string, runs long, total_ms double")
    columns = spark.createDataFrame([("s.t", c) for c in "kxyz"] + [("u", "k")], "table_name string, column_name string")
    roles = profile.column_roles(q, columns)
    got = {(r.query_hash, r.table_name, r.column_name): (r.is_filter, r.is_join, r.is_group) for r in roles.collect()}
    assert got == {("a", "s.t", "x"): (1, 0, 0), ("a", "s.t", "k"): (0, 1, 0), ("a", "u", "k"): (0, 1, 0), ("a", "s.t", "y"): (0, 0, 1)}
    use = {r.column_name: (r.queries, r.runs, r.total_ms) for r in profile.column_usage(roles, q).where("table_name = 's.t'").collect()}
    assert use["x"] == (1, 2, 10.0)
    ops = spark.createDataFrame([("s.t", 1, "(t.K = s.K)", 4.0), ("s.t", 2, "k > 1", 6.0), ("s.t", 3, None, 1.0)], "table_name string, version long, predicate string, duration_ms double")
    assert [tuple(r) for r in profile.merge_predicates(ops, columns).collect()] == [("s.t", "k", 2, 5.0)]
    assert profile.mentions(q.withColumnRenamed("query_text", "text"), spark.createDataFrame([("S.T",)], "name string")).count() == 1
    h = spark.createDataFrame([("q", dt.datetime(2024, 1, 1), 3.0), ("q", dt.datetime(2024, 1, 2), 5.0)], "query_text string, start timestamp, duration_ms double")
    assert profile.summaries(h).first()["mean_ms"] == 4.0 and profile.summaries(h, dt.datetime(2024, 1, 2)).first()["runs"] == 1


def test_resume_and_poll(spark):
    t, now = (lambda d: dt.datetime(2024, 1, d)), dt.datetime(2024, 1, 9)
    h = spark.createDataFrame([(t(1), "FINISHED"), (t(2), "running"), (t(3), "FINISHED")], "start timestamp, status string")
    assert profile.resume_from(h, dt.timedelta(1), now) == t(2)
    assert profile.resume_from(h.where("status <> 'running'"), dt.timedelta(1), now) == t(3)
    assert profile.resume_from(h.limit(0), dt.timedelta(1), now) == t(8)
    assert profile.poll(lambda i: i < 3, 10, lambda s: None) == 4
    with pytest.raises(ZeroDivisionError):
        profile.poll(lambda i: 1 / 0, 10, lambda s: None)
    assert [r.group_number for r in profile.balanced_groups(h, 2, F.col("start")).orderBy("start").collect()] == [1, 1, 2]


def test_sinks(spark, tmp_path, capsys):
    sinks.ConsoleSink().write({"a": 1}, {"w": "x"})
    assert '"a": 1' in capsys.readouterr().out
    sent = []
    sinks.SeriesSink(sent.extend).write({"a": 1, "b": "text", "c": True}, {})
    assert sent == [{"metric": "a", "value": 1.0, "tags": {}}]
    table = sinks.TableSink(spark, str(tmp_path / "m"))
    table.write({"a": "3", "b": "text"}, {"w": "x"})
    table.write({"a": 4}, {})
    assert sorted((r.name, r.number, r.text or "") for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("a", 3.0, ""), ("a", 4.0, ""), ("b", None, "text")]
    out = []
    sinks.alert_each(out.append, most=2)(spark.range(5), 7)
    assert len(out) == 3 and out[-1] == {"batch": 7, "more": 3}
