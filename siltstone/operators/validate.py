"""Comparing two tables by row hashes, counts and columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

def row_hash(columns: Sequence[str | Column], bits: int = 256, separator: str | None = "|", nulls: str | None = None) -> Column:
    """SHA-2 of the columns as text, each behind its length, so only equal rows hash alike; a null counts as no text, which
    is not the empty one.

    For hashes that must agree with those of other systems: `nulls` writes nulls as that text and joins plain texts by the
    separator (None: by nothing). Rows such as (a|b, c) and (a, b|c), or a null and its text, then hash alike.
    """
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    if nulls is None:
        return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), bits)
    text = [F.coalesce(c, F.lit(nulls)) for c in text]
    return F.sha2(F.concat(*text) if separator is None else F.concat_ws(separator, *text), bits)


def hashed(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    return df.withColumn("sha_hash", row_hash(list(columns or df.columns), **options))


def compare(original: DataFrame, other: DataFrame, columns: Sequence[str] | None = None, mode: str = "full", **options) -> DataFrame:
    """Counts of rows and distinct rows on either side, matched rows, and differences.

    Each side is counted by hash before the join, so repeated rows never multiply. mode="left": as a left join from the
    original, where repeated rows multiply and rows of the other side alone aren't seen.
    """
    columns = list(columns or original.columns)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(row_hash(columns, **options).alias("h")).groupBy("h").agg(F.count("*").alias(name))

    both = counted(original, "a").join(counted(other, "b"), "h", "left" if mode == "left" else "full_outer")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    matched = F.sum(F.when(F.col("b").isNotNull(), a * b).otherwise(0)) if mode == "left" else F.sum(F.least(a, b))
    out = both.agg(
        F.coalesce(F.sum(a), F.lit(0)).alias("original_rows"), F.coalesce(F.sum(b), F.lit(0)).alias("other_rows"), F.count("a").alias("original_distinct"), F.count("b").alias("other_distinct"),
        F.coalesce(matched, F.lit(0)).alias("matched_rows"),
    )
    return out.withColumns({
        "count_difference": F.col("original_rows") - F.col("other_rows"),
        "unmatched_share": F.round(1 - F.try_divide(F.col("matched_rows").cast("double"), F.col("original_rows").cast("double")), 6),
    })


def unmatched(original: DataFrame, other: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    columns = list(columns or original.columns)
    return hashed(original, columns, **options).join(hashed(other, columns, **options).select("sha_hash"), "sha_hash", "left_anti").drop("sha_hash")


def matched(original: DataFrame, other: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    columns = list(columns or original.columns)
    return hashed(original, columns, **options).join(hashed(other, columns, **options).select("sha_hash"), "sha_hash", "left_semi").drop("sha_hash")


def column_profile(original: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each column that isn't a key: rows with equal keys whose values differ, in one join and one aggregation."""
    columns = [c for c in original.columns if c not in keys and c in other.columns]
    joined = original.alias("a").join(other.alias("b"), list(keys))
    counts = joined.agg(*(F.count_if(~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))).alias(c) for c in columns))
    return counts.unpivot([], columns, "column_name", "differing_rows")


def column_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    return {"only_left": sorted(set(a.columns) - set(b.columns)), "only_right": sorted(set(b.columns) - set(a.columns)), "both": sorted(set(a.columns) & set(b.columns))}


def row_count_difference(a: DataFrame, b: DataFrame, a_time: str | None = None, b_time: str | None = None, unit: str | None = None) -> DataFrame:
    """Rows on either side, in all or by minute, hour, day, month or year; buckets of one side alone are kept."""
    if unit is None:
        return a.agg(F.count("*").alias("left_rows")).crossJoin(b.agg(F.count("*").alias("right_rows"))).withColumn("difference", F.col("left_rows") - F.col("right_rows"))
    left = a.groupBy(F.date_trunc(unit, a_time).alias("bucket")).agg(F.count("*").alias("left_rows"))
    right = b.groupBy(F.date_trunc(unit, b_time or a_time).alias("bucket")).agg(F.count("*").alias("right_rows"))
    both = left.join(right, "bucket", "full_outer").select("bucket", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"))
    return both.withColumn("difference", F.col("left_rows") - F.col("right_rows"))


def expectations(df: DataFrame, rules: dict[str, Column], drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy the rules named in `drop`, violations of each rule); a null condition is a violation."""
    kept = df
    for name in drop:
        kept = kept.where(F.coalesce(rules[name], F.lit(False)))
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return kept, counts.unpivot([], list(rules), "rule", "violations")


ROWS, KEPT = "rows", "kept"


def _expected(df: DataFrame, rules: dict[str, Column], drop: Sequence[str], fail: Sequence[str], before: Observation | str, after: Observation | str) -> DataFrame:
    holds = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    out = df.observe(before, F.count(F.lit(1)).alias(ROWS), *(F.count_if(~c).alias(n) for n, c in holds.items()))
    for name in fail:
        said = F.concat(F.lit(f"expectation {name} is violated by "), F.to_json(F.struct(*df.columns)))
        out = out.where(F.when(holds[name], True).otherwise(F.raise_error(said).cast("boolean")))
    for name in drop:
        out = out.where(holds[name])
    return out.observe(after, F.count(F.lit(1)).alias(KEPT))


def write_expected(df: DataFrame, rules: dict[str, Column], write: Callable[[DataFrame], None], drop: Sequence[str] = (), fail: Sequence[str] = ()) -> dict[str, int]:
    """Write rows and count what violates each rule in the same pass: {rule: violations, rows: all, kept: written}.

    A null condition is a violation. Rows that violate a rule in `drop` aren't written; one that violates a rule in `fail`
    ends the job, and Spark's committer leaves nothing of it; other rules are only counted. `write` must write the frame
    that it gets, once. Violations are counted before anything is dropped, so rules don't hide one another.
    """
    if {ROWS, KEPT} & set(rules):
        raise ValueError(f"{ROWS} and {KEPT} are counts of their own")
    before, after = Observation(), Observation()
    write(_expected(df, rules, drop, fail, before, after))
    return {**before.get, **after.get}


def expected_stream(df: DataFrame, rules: dict[str, Column], name: str, drop: Sequence[str] = (), fail: Sequence[str] = ()) -> DataFrame:
    """The same for a stream; counts of each micro-batch come with its progress, see ExpectationLog."""
    if {ROWS, KEPT} & set(rules):
        raise ValueError(f"{ROWS} and {KEPT} are counts of their own")
    return _expected(df, rules, drop, fail, name, f"{name}_{KEPT}")


class ExpectationLog(StreamingQueryListener):
    """Counts of streams' expectations as rows (name, batch_id, rule, violations): kept here, or handed to `sink`."""

    def __init__(self, sink: Callable[[dict], None] | None = None):
        self.rows: list[dict] = []
        self.sink = sink or self.rows.append

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, counts in (p.observedMetrics or {}).items():
            for rule, n in counts.asDict().items():
                self.sink({"name": name.removesuffix(f"_{KEPT}"), "batch_id": p.batchId, "rule": rule, "violations": n})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
