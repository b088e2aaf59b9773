"""One row for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "row_number") -> DataFrame:
    """The first n rows of each key (rank: row_number, rank or dense_rank); give an order without ties for a fixed choice.

    Written as a filtered window, which Spark cuts down to n rows a key in each task before the shuffle.
    """
    place = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[rank]()
    return df.withColumn("__place", place.over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= n).drop("__place")


def latest(df: DataFrame, keys: Sequence[str], by: str, *ties: str) -> DataFrame:
    """The newest row of each key; ties go to the larger value of `ties`."""
    return top_rows(df, keys, [F.desc_nulls_last(by), *(F.desc_nulls_last(t) for t in ties)])


def golden_record(df: DataFrame, keys: Sequence[str], by: str, valid: dict[str, Column | None], also: Sequence[Column] = ()) -> DataFrame:
    """For each key the newest valid value of each attribute: {attribute: condition, or None for not null}; `also` adds
    aggregates of all of the key's rows.

    One aggregation, combined before the shuffle; an attribute without any valid value is null.
    """
    picked = [F.max_by(F.col(c), F.when(F.col(c).isNotNull() if ok is None else F.col(c).isNotNull() & ok, F.col(by))).alias(c) for c, ok in valid.items()]
    return df.groupBy(*keys).agg(*picked, *also)


def max_record(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The cheaper golden record: the largest value of each attribute."""
    return df.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))
