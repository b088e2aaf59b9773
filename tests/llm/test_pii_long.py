"""Personal data in texts with very many matches, and the parts that make this linear, against plain loops."""

import random
import time

from pyspark.sql import functions as F

from siltstone.llm import pii
from siltstone.llm.pii import op5_personal_data, redact

from .helpers import documents, save
from .test_models import brute_spans


def test_many_matches_in_one_text(spark, tmp_path):
    rng = random.Random(1)
    numbers = [rng.choice([str(rng.randint(0, 99999)), f"{rng.randint(0, 255)}.1.2.{rng.randint(0, 300)}", str(rng.randint(10**12, 10**15)), f"a{rng.randint(0, 9)}@b.co"]) for _ in range(200_000)]
    text = " ".join(numbers)
    sf = save(documents(spark, [text, "x"]), tmp_path, "documents")
    began = time.monotonic()
    got = {r.doc_id: r.spans for r in op5_personal_data(spark, sf).collect()}
    took = time.monotonic() - began
    want = brute_spans(text)
    assert [x for x in got[0].split(",") if x.split(":")[0] in pii.BASE] == want and len(want) > 50_000
    assert took < 60, took  # 200,000 numbers; a quadratic way takes an hour
    began = time.monotonic()
    clean = {r.doc_id: r.text for r in redact(documents(spark, [text, "x"])).collect()}[0]
    assert clean.count("[EMAIL]") == sum(x.startswith("email") for x in want) and "@" not in clean
    assert time.monotonic() - began < 60


def test_covering_and_overlaps_equal_loops(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        text = "".join(rng.choice("ab😀é\n") for _ in range(rng.choice([5, 60, 5000])))
        some = lambda n, text=text: [(rng.choice(["x", "y"]), a, min(len(text), a + rng.randint(1, 9)), 0, 0) for a in (rng.randrange(len(text)) for _ in range(n))]
        rows.append((i, text, some(rng.randint(0, 12)), some(rng.randint(0, 12))))
    span = "array<struct<kind:string,start:int,end:int,votes:int,features:int>>"
    df = spark.createDataFrame(rows, f"i long, text string, a {span}, b {span}").repartition(2)
    sorted_ = F.array_sort(F.transform("a", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.withColumn("s", sorted_).withColumn("covered", F.when(F.size("s") > 0, pii._covered(F.col("text"), F.col("s"), 64)).otherwise(F.col("text"))).withColumn("clear", pii._clear_of(F.col("a"), F.col("b")))
    got = {r.i: r for r in df.collect()}
    for i, text, a, b in rows:
        at, out = 0, ""
        for start, end, kind in sorted((s[1], s[2], s[0]) for s in a):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert got[i].covered == out + text[at:]
        assert sorted(map(tuple, got[i].clear)) == sorted(y for y in b if not any(x[1] < y[2] and y[1] < x[2] for x in a))
