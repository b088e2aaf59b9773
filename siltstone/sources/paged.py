"""Paged services as Spark data sources; services are injected, so that tests use local ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.errors import PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (filters, page token or None) -> (rows, next token or None). Filters count on the first page only.
FetchPage = Callable[[dict, str | None], tuple[list[dict], str | None]]


def pages(fetch: FetchPage, filters: dict, most_pages: int | None = None) -> Iterator[dict]:
    token, n = None, 0
    while True:
        rows, token = fetch(filters if token is None else {}, token)
        yield from rows
        n += 1
        if not token or (most_pages and n >= most_pages):
            return


def offset_pages(fetch: Callable[[int, int], list[dict]], size: int = 100) -> Iterator[dict]:
    """Pages by offset until one is short."""
    at = 0
    while True:
        rows = fetch(at, size)
        yield from rows
        if len(rows) < size:
            return
        at += size


def paged_table(spark: SparkSession, fetch: FetchPage, schema: T.StructType | str, windows: Sequence[dict]) -> DataFrame:
    """Rows of a paged service, one task for each filter (such as an hour or a warehouse); fetch must be picklable."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.fieldNames()
    import json

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for text in pdf["filters"]:
                rows = [{c: r.get(c) for c in names} for r in pages(fetch, json.loads(text))]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    asked = spark.createDataFrame([(json.dumps(w),) for w in windows], "filters string").repartition(max(1, len(windows)))
    return asked.mapInPandas(run, kind)


def statement_result(spark: SparkSession, rows: list[list], schema: T.StructType) -> DataFrame:
    """Rows of a statement with its schema: as they are if each value has its column's type; else all values are read as
    texts and cast, and one that can't be cast becomes null. The rows of a page are on the driver; see sources.pages for
    results of many."""
    try:
        return spark.createDataFrame([tuple(r) for r in rows], schema, verifySchema=True)
    except (PySparkTypeError, PySparkValueError):
        pass
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.createDataFrame([[None if v is None else str(v) for v in r] for r in rows], texts)
    return raw.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields))


class SqlRunner(Protocol):
    def sql(self, statement: str) -> DataFrame: ...


def run_script(runner: SqlRunner, script: str, retries: int = 0, wait: Callable[[float], None] | None = None) -> list[dict]:
    """Run a script's statements in order; status of each. A failure stops the script after `retries` tries more, with
    waits of 1, 2, 4 ... 60 seconds."""
    import time

    from ..functions.expressions import statements

    out = []
    for text in statements(script):
        for k in range(retries + 1):
            try:
                result = runner.sql(text)
                out.append({"statement": text, "status": "SUCCEEDED", "result": result})
                break
            except Exception as e:
                if k == retries:
                    out.append({"statement": text, "status": "FAILED", "error": str(e).splitlines()[0]})
                    return out
                (wait or time.sleep)(min(2**k, 60))
    return out


def run_graph(runner: SqlRunner, scripts: dict[str, str], after: dict[str, Sequence[str]], most: int = 10) -> dict[str, list[dict]]:
    """Run named scripts, each when those it comes `after` have succeeded; those after a failed one are left out.

    Scripts that are ready run at once. What each gave, by name.
    """
    from graphlib import TopologicalSorter

    order, out = TopologicalSorter({name: after.get(name, ()) for name in scripts}), {}
    order.prepare()
    while order.is_active():
        ready = [n for n in order.get_ready()]
        runs = [n for n in ready if all(out.get(a) and out[a][-1]["status"] == "SUCCEEDED" for a in after.get(n, ()))]
        for name, result in zip(runs, in_parallel(runs, lambda n: run_script(runner, scripts[n]), most)):
            out[name] = result if isinstance(result, list) else [{"statement": name, "status": "FAILED", "error": str(result)}]
        order.done(*ready)
    return out


def measured(spark: SparkSession, queries: dict[str, Callable], repetitions: int = 3, at_once: int = 1) -> DataFrame:
    """query, repetition, seconds, failed: each query run to its end `repetitions` times, `at_once` of them together."""
    import time

    def work(job):
        name, k = job
        began = time.perf_counter()
        try:
            queries[name]().write.format("noop").mode("overwrite").save()
            failed = False
        except Exception:
            failed = True
        return name, k, time.perf_counter() - began, failed

    rows = in_parallel([(n, k) for k in range(repetitions) for n in queries], work, at_once)
    return spark.createDataFrame(rows, "query string, repetition int, seconds double, failed boolean")


def benchmark_rates(runs: DataFrame) -> DataFrame:
    """query, runs, failures, mean and largest seconds, and how many it makes a minute, one after the other."""
    return runs.groupBy("query").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("most_seconds")).withColumn("a_minute", 60 / F.col("mean_seconds"))


def in_parallel(jobs: Sequence, work: Callable, most: int = 10) -> list:
    """work(job) for each job on driver threads, each a Spark job of its own; results or exceptions in order."""

    def safe(job):
        try:
            return work(job)
        except Exception as e:
            return e

    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(safe, jobs))


def migrate(runner: SqlRunner, scripts: DataFrame, most: int = 3) -> list[dict]:
    """Run the statements of catalog.migration_scripts(), `most` at once: all tables first, then the views, which may name
    any of them. Views may name other views: those that fail are tried again as long as some succeed. A row of status for
    each statement's last try. Statements are configuration, one for each table."""
    said: dict[int, dict] = {}
    rows = list(enumerate(scripts.orderBy("step", "schema_name", "table_name").collect()))

    def work(job) -> tuple[int, dict]:
        at, row = job
        try:
            runner.sql(row["statement"]).collect()
            return at, {"table_name": row["table_name"], "step": row["step"], "status": "SUCCEEDED", "error": None}
        except Exception as e:
            return at, {"table_name": row["table_name"], "step": row["step"], "status": "FAILED", "error": str(e)[:500]}

    for step in (1, 2):
        open_ = [x for x in rows if x[1]["step"] == step]
        while open_:
            said.update(dict(in_parallel(open_, work, most)))
            failed = [x for x in open_ if said[x[0]]["status"] == "FAILED"]
            open_ = failed if step == 2 and len(failed) < len(open_) else []
    return [said[at] for at, _ in rows]
