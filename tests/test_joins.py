"""Overlap, skewed and containment joins; numbers and shares over many ranges; expectations in passing."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import costs, intervals, profile, runlog, skew, validate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlap_join(spark, keys):
    rng = random.Random(1)

    def some(n):
        starts = [rng.randint(-(10**6), 10**6) if rng.random() < 0.97 else None for _ in range(n)]
        return [(i, rng.choice([0, 1, None]), s, None if s is None or rng.random() < 0.05 else s + rng.choice([0, 1, 5, 100, 3000, 10**5, 10**6, -3])) for i, s in enumerate(starts)]

    a, b = some(200), some(150)
    left = spark.createDataFrame(a, "i long, k long, s long, e long").selectExpr("i", "k", "timestamp_seconds(s) s", "timestamp_seconds(e) e")
    right = spark.createDataFrame(b, "j long, k long, s2 long, e2 long").selectExpr("j", "k", "timestamp_seconds(s2) s2", "timestamp_seconds(e2) e2")
    found = intervals.overlap_join(left, right if keys else right.drop("k"), ("s", "e"), ("s2", "e2"), keys)
    end = lambda x: 10**12 if x[3] is None else x[3]
    valid = lambda rows: [x for x in rows if x[2] is not None and end(x) >= x[2]]
    want = sorted((x[0], y[0]) for x in valid(a) for y in valid(b) if (not keys or x[1] == y[1] is not None) and x[2] < end(y) and y[2] < end(x))
    assert sorted((r.i, r.j) for r in found.collect()) == want and want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_overlap_join_of_nothing(spark):
    none = spark.createDataFrame([], "i long, s timestamp, e timestamp")
    assert intervals.overlap_join(none, none.toDF("j", "s2", "e2"), ("s", "e"), ("s2", "e2")).collect() == []


def test_overlap_join_shuffles_only_what_can_meet(spark):
    """Intervals shorter than all of the other side meet at the other's level only, not at their own."""
    left = spark.range(2000).selectExpr("id i", "timestamp_seconds(id * 60) s", "timestamp_seconds(id * 60 + 2) e")
    right = spark.range(50).selectExpr("id j", "timestamp_seconds(id * 2400) s2", "timestamp_seconds(id * 2400 + 3600) e2")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = intervals.overlap_join(left, right, ("s", "e"), ("s2", "e2"))
        before = shuffled()
        rows = found.count()
        assert rows == sum(60 * i < 2400 * j + 3600 and 2400 * j < 60 * i + 2 for i in range(2000) for j in range(50))
        assert shuffled() - before < 3000, shuffled() - before  # each left row once, each right one twice at most, and counts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_half_of_all_rows_on_one_key(spark):
    """No task of the join gets over twice the mean; the result is that of a plain join."""
    left = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 5000).alias("k"), "id")
    right = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")).where("k <> 11")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            found, plain = skew.salted_join(left, right, ["k"], how), left.join(right, ["k"], how)
            digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
            assert digest(found) == digest(plain)
            if how == "inner":
                sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
                assert max(sizes) <= 2 * sum(sizes) / 4, sizes
                assert max(r[0] for r in plain.groupBy(F.spark_partition_id()).count().select("count").collect()) > 2 * sum(sizes) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_heavy_keys_are_few_and_all(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 2).otherwise(F.col("id")).alias("k"))
    found, n = skew.heavy_keys(df, ["k"], 0.1)
    assert n == 10_000 and len(found) == 2 and all(3300 <= c <= 3400 for _, c in found)
    assert skew.heavy_keys(df.limit(0), ["k"], 0.1) == ([], 0)


@pytest.mark.parametrize("few", [50_000, 0])
def test_mentions(spark, few):
    rng = random.Random(2)
    texts = [(i, rng.choice([None, "", "x"]) if i % 11 == 0 else "".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    names = ["a", "B", "ab", "ABB", "é b", "bba\n", "aaaaaa", "", None, "ab", "zz", "b" * 50]
    found = profile.mentions(spark.createDataFrame(texts, "i long, text string"), spark.createDataFrame([(j, n) for j, n in enumerate(names)], "j long, name string"), broadcast_names=few)
    want = sorted((i, j) for i, t in texts for j, n in enumerate(names) if t and n and n.lower() in t.lower())
    assert sorted((r.i, r.j) for r in found.collect()) == want and want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_keys_and_shares_over_many_ranges(spark):
    """More rows than a range sample has, and a further column that is used."""
    df = spark.range(1_200_000).select((F.xxhash64("id") % 1_000_003).alias("v"), "id", F.concat(F.lit("p"), "id").alias("payload"))
    keyed = runlog.with_keys(df, "k", 5, ["v", "id"])
    got = keyed.agg(F.count_distinct("k").alias("d"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("payload") != F.concat(F.lit("p"), "id")).alias("bad")).first()
    assert tuple(got) == (1_200_000, 6, 1_200_005, 0)
    shares = costs.pareto(df.withColumn("v", F.abs("v") + 1), "v", "id")
    top = shares.where("payload is not null").agg(F.max("cumulative").alias("high"), F.sum("share").alias("all"), F.count("*").alias("n")).first()
    assert abs(top.high - 1) < 1e-9 and abs(top["all"] - 1) < 1e-9 and top.n == 1_200_000
    from pyspark.sql import Window

    bucket = shares.groupBy(F.floor(F.col("v") / 50_000).alias("b")).agg(F.min("cumulative").alias("low"), F.max("cumulative").alias("high"), F.sum("share").alias("s"))
    falls = bucket.withColumn("next", F.lead("low").over(Window.orderBy(F.desc("b")))).where("next < high OR high - low > s").count()
    assert falls == 0


def test_expectations_in_passing(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1), (4, 7)], "id long, v long")
    rules = {"positive": F.col("v") > 0, "small": F.col("id") < 4}
    got = validate.write_expected(df, rules, lambda x: x.write.parquet(f"{tmp_path}/a"), drop=["positive"])
    assert got == {"rows": 4, "positive": 2, "small": 1, "kept": 2}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/a").collect()) == [1, 4]
    with pytest.raises(Exception, match="expectation small is violated"):
        validate.write_expected(df, rules, lambda x: x.write.parquet(f"{tmp_path}/b"), fail=["small"])
    import os

    assert not os.path.exists(f"{tmp_path}/b/_SUCCESS")
    with pytest.raises(ValueError):
        validate.write_expected(df, {"rows": F.lit(True)}, lambda x: None)


def test_expectations_of_a_stream(spark, tmp_path):
    from siltstone.streaming.streams import drain

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = validate.ExpectationLog()
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
        drain(validate.expected_stream(stream, {"even": F.col("id") % 2 == 0, "low": F.col("id") < 25}, "rules", drop=["even"]), f"{tmp_path}/c", f"{tmp_path}/out")
        for _ in range(100):
            if sum(r["rule"] == "kept" for r in log.rows) >= 3:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    total = lambda rule: sum(r["violations"] for r in log.rows if r["rule"] == rule and r["name"] == "rules")
    assert (total("rows"), total("even"), total("low"), total("kept")) == (30, 15, 5, 15)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15


def test_row_hash_tells_rows_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("␀", "x"), (None, "x"), ("-", "x"), ("1:a", ""), ("", "1:a")], "x string, y string")
    assert df.select(validate.row_hash(["x", "y"])).distinct().count() == 7
