"""Usage and what it costs; facts about queries and warehouses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .dedup import latest


def priced(usage: DataFrame, prices: DataFrame, sku: str = "sku_name", quantity: str = "usage_quantity", price: str = "price", since: str = "price_start_time", discounts: dict[str, float] | None = None) -> DataFrame:
    """Usage at the latest list price of its SKU, less a discount by words in the SKU's name (first match)."""
    now = latest(prices, [sku], since, price).select(sku, price)
    factor = F.lit(1.0)
    for words, off in reversed(list((discounts or {}).items())):
        factor = F.when(F.contains(F.upper(sku), F.lit(words.upper())), 1 - off).otherwise(factor)
    return usage.join(now, sku, "left").withColumn("cost", F.coalesce(F.col(quantity) * F.col(price), F.lit(0.0)) * factor)


def against_budget(costs: DataFrame, budgets: DataFrame, sku: str = "sku", time: str = "usage_start_time") -> DataFrame:
    """Hourly cost against an hourly budget of its SKU."""
    hourly = costs.groupBy(sku, F.date_trunc("hour", time).alias("hour")).agg(F.sum("cost").alias("cost"))
    return hourly.join(budgets, sku, "left").withColumn("over_budget", F.coalesce(F.col("cost") > F.col("hourly_budget"), F.lit(False)))


def rolling(df: DataFrame, value: str, order: Sequence[str | Column], rows: dict[str, int], keys: Sequence[str] = ()) -> DataFrame:
    """Means over the current and the n rows before it: {name: n}. Without keys all rows go through one task: aggregate
    to hours or days first."""
    return df.withColumns({name: F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, 0)) for name, n in rows.items()})


def bands(df: DataFrame, value: str, order: Sequence[str], rows: int, keys: Sequence[str] = (), width: float = 2.0) -> DataFrame:
    """Rolling mean, deviation, and the band around the mean."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, 0)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("deviation", F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))).withColumns({"lower": F.col("mean") - width * F.col("deviation"), "upper": F.col("mean") + width * F.col("deviation")})


def trend_alert(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), threshold: float = 20.0) -> DataFrame:
    """Means of 12 and 24 rows, change in percent against 12 and 24 rows before, and whether it exceeds the threshold."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rolling(df, value, order, {"mean_12": 11, "mean_24": 23}, keys)
    for n in (12, 24):
        before = F.lag(value, n, 0.0).over(w)
        out = out.withColumn(f"change_{n}", F.try_divide(F.col(value) - before, before) * 100)
    return out.withColumn("alert", F.coalesce(F.col("change_12") > threshold, F.lit(False)) | F.coalesce(F.col("change_24") > threshold, F.lit(False)))


def pareto(df: DataFrame, value: str, name: str, cutoff: float = 0.8) -> DataFrame:
    """Share, cumulative share from the largest on, and whether a row is among those that make up the cutoff.

    Rows are dealt out by ranges of value and written once; running sums within a range go on from the sums of the ranges
    before it, a row for each range, both from what was written. So no task gets all rows, and sums and rows agree on the
    ranges. Rows with equal value and name count together, as peers do.
    """
    ranged = written(df.repartitionByRange(F.desc(value), F.col(name)).withColumn("__range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    w = Window.orderBy("__range")
    ahead = sums.select("__range", F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))
    running = F.sum(value).over(Window.partitionBy("__range").orderBy(F.desc(value), name)) + F.col("__ahead")
    # one row for each range
    out = ranged.join(F.broadcast(ahead), "__range").withColumn("share", F.col(value) / F.col("__total")).withColumn("cumulative", running / F.col("__total"))
    return out.withColumn("vital", F.col("cumulative") - F.col("share") < cutoff).drop("__range", "__ahead", "__total")


def query_facts(history: DataFrame) -> DataFrame:
    """Flags, sizes and ratios of query history rows (durations in ms, sizes in bytes), each from its own column."""
    gb = lambda c: F.col(c) / (1 << 30)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return history.withColumns({
        "read_gb": gb("read_bytes"), "written_gb": gb("written_bytes"), "spilled_gb": gb("spilled_bytes"), "is_spilled": F.coalesce(F.col("spilled_bytes") > 0, F.lit(False)),
        "pruned_share": F.coalesce(F.try_divide(F.col("pruned_files").cast("double"), (F.col("pruned_files") + F.col("read_files")).cast("double")), F.lit(0.0)),
        "compile_share": ratio("compilation_duration_ms", "total_duration_ms"), "queue_share": ratio("waiting_at_capacity_duration_ms", "total_duration_ms"),
        "is_failed": F.coalesce(F.col("execution_status") == "FAILED", F.lit(False)),
    })


def warehouse_summary(facts: DataFrame) -> DataFrame:
    """For each warehouse and day: queries, share that failed or spilled, time queued, and GB read."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return facts.groupBy("warehouse_id", F.to_date("start_time").alias("day")).agg(
        F.count("*").alias("queries"), share("is_failed").alias("failed_share"), share("is_spilled").alias("spilled_share"), F.sum("waiting_at_capacity_duration_ms").alias("queued_ms"), F.round(F.sum("read_gb"), 6).alias("read_gb"),
    )


def both_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Numbers of a key's versions from the first and from the last."""
    forward = Window.partitionBy(*keys).orderBy(*order)
    backward = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumns({"forward_rank": F.row_number().over(forward).cast("long"), "backward_rank": F.row_number().over(backward).cast("long")})


def growth(df: DataFrame, date: str, now: Column, days: int, keys: Sequence[str], value: str) -> DataFrame:
    """A snapshot against that of `days` before: value, before, growth in percent (null without a value before)."""
    today = df.where(F.col(date) == now).select(*keys, F.col(value).alias("now"))
    before = df.where(F.col(date) == F.date_sub(now, days)).select(*keys, F.col(value).alias("before"))
    return today.join(before, list(keys), "left").withColumn("growth", F.try_divide((F.col("now") - F.col("before")).cast("double"), F.col("before").cast("double")) * 100)
