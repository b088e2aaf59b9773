"""Percentiles and distinct counts from stored sketches: each hour is read once, any range of hours is merged from its sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hourly(df: DataFrame, time: str, keys: Sequence[str] = (), quantiles_of: Sequence[str] = (), distinct_of: Sequence[str] = (), k: int = 800, lg_k: int = 12, unit: str = "hour") -> DataFrame:
    """A row for each hour (or other unit) and key: rows, a KLL sketch of each numeric column in `quantiles_of`
    (`kll_<column>`, rank error about 0.7 % at k = 800) and an HLL sketch of each column in `distinct_of` (`hll_<column>`,
    standard error about 1.6 % at lg_k = 12).

    Sketches are aggregates with map-side combine; what is stored has a size that does not depend on the rows. Nulls are in
    no sketch; rows without a time are in the hour null. Columns of other types than long, string and binary are
    sketched as text.
    """
    plain = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    hashable = lambda c: F.col(c) if plain[c] in ("bigint", "string", "binary") else F.col(c).cast("string")
    return df.groupBy(F.date_trunc(unit, time).alias("hour"), *keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"kll_{c}") for c in quantiles_of),
        *(F.hll_sketch_agg(hashable(c), lg_k).alias(f"hll_{c}") for c in distinct_of),
    )


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketches of each key over all hours given (filter them before): one row each, that can be merged on."""
    names = [c for c in sketches.columns if c.startswith(("kll_", "hll_"))]
    union = lambda c: (F.kll_merge_agg_double(c) if c.startswith("kll_") else F.hll_union_agg(c)).alias(c)
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), *map(union, names))


def quantile(column: str, p: float) -> Column:
    """The value at rank p of a column that was sketched; null if it had no values."""
    sketch = F.col(f"kll_{column}")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def distinct(column: str) -> Column:
    """How many different values a sketched column had, about."""
    return F.hll_sketch_estimate(F.col(f"hll_{column}"))
