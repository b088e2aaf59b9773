"""Merges, as functions from a target and a source to the new target.

Spark's own tables know no MERGE; so the new state is a DataFrame, which the caller writes as a new snapshot or over
the partitions that changed. All are one join on the keys, and keep the target's columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import latest

INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"


def t(name: str) -> Column:
    """A column of the target in a merge's conditions."""
    return F.col(f"t.`{name}`")


def s(name: str) -> Column:
    """A column of the source in a merge's conditions."""
    return F.col(f"s.`{name}`")


@dataclass
class When:
    """A clause: `do` update, delete or insert; under a condition; with `values` ({column: expression}; default: the
    source's columns of the same name, but for those in `skip`)."""

    do: str
    condition: Column | None = None
    values: dict[str, Column] | None = None
    skip: Sequence[str] = field(default_factory=tuple)


def _aligned(target: DataFrame, source: DataFrame, evolve: bool) -> DataFrame:
    if not evolve:
        return target
    new = [f for f in source.schema.fields if f.name not in target.columns]
    return target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new}) if new else target


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[When], evolve: bool = False, on: Column | None = None, changes: bool = False, check: bool = True) -> DataFrame:
    """Apply ordered clauses: for each pair of rows with equal keys (and `on`) the first update or delete that holds, for
    each source row without a match the first insert that holds. Rows without a match in the source stay.

    `evolve` adds the source's new columns to the target. With `changes`, gives the change rows instead of the new state:
    _change_type is insert, delete, or update_preimage and update_postimage. Source rows that share their keys are an
    error (`check`) if a clause changes a target row by one of them, as the result would depend on their order; if none
    does, the target row stays once. Keys never match on null.

    The source is counted by key before the join, which has the same partitioning; so there is one shuffle of each side.
    """
    target = _aligned(target, source, evolve)
    columns = target.columns
    right = source.withColumn("__in_s", F.lit(True))
    if check:
        w = _by_keys(keys)
        right = right.withColumns({"__same": F.count(F.lit(1)).over(w), "__place": F.row_number().over(w.orderBy(*keys))})
    condition = on if on is not None else F.lit(True)
    for k in keys:
        condition = condition & (t(k) == s(k))
    joined = target.withColumn("__in_t", F.lit(True)).alias("t").join(right.alias("s"), condition, "full_outer")
    in_t, in_s = F.col("t.__in_t").isNotNull(), F.col("s.__in_s").isNotNull()
    action = F.lit("keep")
    for number, clause in reversed(list(enumerate(clauses))):
        holds = clause.condition if clause.condition is not None else F.lit(True)
        where = in_t & in_s if clause.do in ("update", "delete") else in_s & ~in_t
        action = F.when(where & F.coalesce(holds, F.lit(False)), F.lit(f"{clause.do}{number}")).otherwise(action)
    if check:
        several = in_t & in_s & (F.col("s.__same") > 1)
        action = F.when(several & ((action != "keep") | F.lit(on is not None)), F.raise_error(F.lit("several source rows match one target row")).cast("string")).when(several & (F.col("s.__place") > 1), "drop").otherwise(action)
    joined = joined.withColumn("__do", action)

    def value(c: str) -> Column:
        out = t(c)
        for number, clause in enumerate(clauses):
            if clause.do == "delete":
                continue
            given = clause.values if clause.values is not None else {x: s(x) for x in source.columns if x in columns and x not in clause.skip}
            if c in given:
                out = F.when(F.col("__do") == f"{clause.do}{number}", given[c]).otherwise(out)
        return out

    before = [t(c).alias(c) for c in columns]
    after = [value(c).cast(target.schema[c].dataType).alias(c) for c in columns]
    kind = F.regexp_replace("__do", "[0-9]+$", "")
    if not changes:
        return joined.where(~kind.isin("delete", "drop") & (in_t | (F.col("__do") != "keep"))).select(*after)
    rows = joined.where(~F.col("__do").isin("keep", "drop")).select(kind.alias("__do"), F.struct(*before).alias("b"), F.struct(*after).alias("a"))

    def said(row: str, name: str) -> Column:
        return F.struct(F.col(row).alias("r"), F.lit(name).alias("k"))

    pair = F.when(F.col("__do") == "update", F.array(said("b", BEFORE), said("a", AFTER))).when(F.col("__do") == "delete", F.array(said("b", DELETE))).otherwise(F.array(said("a", INSERT)))
    return rows.select(F.explode(pair).alias("x")).select("x.r.*", F.col("x.k").alias("_change_type"))


def _unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source; rows that share their keys are an error when they are read. Null keys match nothing and may repeat."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    same = F.count(F.lit(1)).over(_by_keys(keys))
    wrong = F.raise_error(F.lit("several source rows have the same keys")).cast("boolean")
    return source.withColumn("__same", same).where(F.when(whole & (F.col("__same") > 1), wrong).otherwise(True)).drop("__same")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Update all columns and insert all: the target's other rows and the source. Source keys that repeat are an error, as in
    merge() (`check=False`: they are known to be unique); null keys match nothing."""
    taken = _unique(source, keys) if check else source
    return target.join(source, list(keys), "left_anti").select(*target.columns).unionByName(taken.select(*[c for c in source.columns if c in target.columns]), allowMissingColumns=True)


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti").select(*source.columns), allowMissingColumns=True)


def delete_matching(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(source, list(keys), "left_anti")


def update_columns(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Take `columns` from matching source rows; insert nothing. Source keys that repeat are an error."""
    right = _unique(source, keys).select(*keys, F.lit(True).alias("__m"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = target.join(right, list(keys), "left")
    return joined.select(*(F.when(F.col("__m"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def merge_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], time: str, late: str = "newer", evolve: bool = False) -> DataFrame:
    """Apply change rows (_change_type insert, update_postimage, delete): the newest of each key counts; it updates or
    deletes a target row only if it is newer, and inserts unless it is a delete. `late="insert"`: a change that isn't
    newer doesn't match and is added as a second row."""
    newest = latest(changes.where(F.col("_change_type") != BEFORE), keys, time, "_change_type")
    write = s("_change_type").isin(INSERT, AFTER)
    newer = (s(time) > t(time)) | t(time).isNull()
    on = (s(time) > t(time)) if late == "insert" else None
    clauses = [When("update", write & newer), When("delete", (s("_change_type") == DELETE) & newer), When("insert", write)]
    drop = [c for c in ("_change_type", "_commit_version", "_commit_timestamp") if c not in target.columns]
    source = newest
    for c in clauses:
        c.skip = tuple(drop)
    return merge(_aligned(target, newest.drop(*drop), evolve), source, keys, clauses, on=on)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str, delete_when: Column | None = None, skip: Sequence[str] = (), scd: int = 1, **scd2) -> DataFrame:
    """Out-of-order changes by sequence: type 1 keeps the latest row of each key, type 2 all of its history."""
    if scd == 2:
        return scd2_merge(target, changes.drop(*skip), keys, sequence, **scd2)
    newest = latest(changes, keys, sequence).withColumn("__gone", F.coalesce(delete_when, F.lit(False)) if delete_when is not None else F.lit(False))
    newer = (s(sequence) > t(sequence)) | t(sequence).isNull()
    gone = s("__gone")
    return merge(target, newest, keys, [When("delete", gone & newer), When("update", ~gone & newer, skip=("__gone", *skip)), When("insert", ~gone, skip=("__gone", *skip))])


def scd2_merge(target: DataFrame, updates: DataFrame, keys: Sequence[str], time: str, tracked: Sequence[str] | None = None, start: str = "start_time", end: str = "end_time", current: str = "is_current", null_safe: bool = True) -> DataFrame:
    """History: each version of a key is a row valid from `start` to `end` (null: still valid).

    All updates of a key are put in order of `time`, so a batch may hold several; an update whose tracked columns equal
    the version before it opens none, and updates not newer than the current version are ignored. `null_safe=False`
    compares as SQL does, so that changes from or to null open no version.
    """
    columns = [c for c in target.columns if c not in (start, end, current)]
    tracked = list(tracked or [c for c in columns if c not in (*keys, time)])
    open_rows = target.where(F.col(current))
    closed = target.where(~F.col(current))
    now = open_rows.select(*columns, F.col(start).alias("__at"), F.lit(0).alias("__new"))
    new = updates.select(*columns, F.col(time).cast(target.schema[start].dataType).alias("__at"), F.lit(1).alias("__new"))
    w = _by_keys(keys).orderBy("__at", "__new")
    both = now.unionByName(new.dropDuplicates([*keys, "__at"])).withColumn("__base", F.max(F.when(F.col("__new") == 0, F.col("__at"))).over(_by_keys(keys)))
    both = both.where((F.col("__new") == 0) | F.col("__base").isNull() | (F.col("__at") > F.col("__base")))
    differs = F.lit(False)
    for c in tracked:
        before = F.lag(c).over(w)
        differs = differs | (~F.col(c).eqNullSafe(before) if null_safe else F.coalesce(F.col(c) != before, F.lit(False)))
    kept = both.withColumn("__keep", (F.col("__new") == 0) | F.row_number().over(w).eqNullSafe(F.lit(1)) | differs).where("__keep")
    until = F.lead("__at").over(w)
    history = kept.withColumn("__until", until).select(*columns, F.col("__at").alias(start), F.col("__until").alias(end), F.col("__until").isNull().alias(current))
    return closed.unionByName(history.select(*target.columns))


def snapshot(history: DataFrame | None, source: DataFrame, keys: Sequence[str], now: Column, updated_at: str | None = None, check: Sequence[str] | None = None, hard_deletes: bool = False, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The history of a source that holds each key's state of today: a row for each version, open ones without `end`.

    Two strategies: by `updated_at`, a version is new if it is newer than the open one, and begins then; by `check`, it is new if one of these
    columns differs (null-safe), and begins `now`. With `hard_deletes` the open version of a key that the source lacks ends
    now. Keys that repeat in the source are an error; null keys match nothing, so each run adds them. One join on the keys of
    open versions; closed ones pass through. The first history: None.
    """
    if (updated_at is None) == (check is None):
        raise ValueError("pass updated_at or check")
    begins = F.col(updated_at).cast("timestamp") if updated_at else now.cast("timestamp")
    fresh = _unique(source, keys).withColumn("__begins", begins)
    columns = source.columns
    made = lambda df: df.select(*columns, F.col("__begins").alias(start), F.lit(None).cast("timestamp").alias(end))
    if history is None:
        return made(fresh)
    old, new = history.where(F.col(end).isNull()).withColumn("__old", F.lit(True)).alias("t"), fresh.withColumn("__new", F.lit(True)).alias("s")
    both = old.join(new, [t(k) == s(k) for k in keys], "full_outer")
    is_old, is_new = F.col("t.__old").isNotNull(), F.col("s.__new").isNotNull()
    differs = F.coalesce(s(updated_at) > t(updated_at), s(updated_at).isNotNull() & t(updated_at).isNull()) if updated_at else F.lit(False)
    for c in check or ():
        differs = differs | ~t(c).eqNullSafe(s(c))
    changed = is_old & is_new & differs
    ended = F.when(changed, s("__begins")).when(is_old & ~is_new & F.lit(hard_deletes), now.cast("timestamp"))
    kept = F.struct(*(t(c).alias(c) for c in columns), t(start).alias(start), ended.alias(end))
    added = F.struct(*(s(c).alias(c) for c in columns), s("__begins").alias(start), F.lit(None).cast("timestamp").alias(end))
    rows = both.select(F.explode(F.array_compact(F.array(F.when(is_old, kept), F.when(changed | ~is_old, added)))).alias("x")).select("x.*")
    return history.where(F.col(end).isNotNull()).select(*columns, start, end).unionByName(rows)


def _by_keys(keys: Sequence[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def incremental_merge(target: DataFrame | None, source: DataFrame, keys: Sequence[str], watermark: str) -> DataFrame:
    """First run: the newest row of each key. Later: only rows newer than the target's newest watermark are merged."""
    if target is None:
        return latest(source, keys, watermark)
    high = target.agg(F.max(watermark)).first()[0]
    # a literal, so that the filter reaches the scan
    fresh = source if high is None else source.where(F.col(watermark) > F.lit(high))
    return upsert(target, latest(fresh, keys, watermark), keys, check=False)


def merge_feed(target: DataFrame, feed: DataFrame, keys: Sequence[str], time: str, version: str = "_src_commit_version") -> DataFrame:
    """Merge only what a change feed (_change_type, _commit_version) holds beyond the newest version in the target's
    `version` column; the version is read first, so the feed is filtered by a literal."""
    high = target.agg(F.max(version)).first()[0]
    fresh = feed.where(F.col("_commit_version") > F.lit(-1 if high is None else high)).withColumn(version, F.col("_commit_version"))
    return merge_changes(target, fresh, keys, time)


def refreshed(target: DataFrame | None, source: DataFrame, keys: Sequence[str], time: str, full: bool = False) -> tuple[DataFrame, str]:
    """(new state, "full" or "incremental"): a copy of the source; of its newer rows alone if the target is there, has the
    source's columns, and no full refresh is asked for."""
    if full or target is None or [(f.name, f.dataType) for f in target.schema.fields] != [(f.name, f.dataType) for f in source.schema.fields]:
        return latest(source, keys, time), "full"
    return incremental_merge(target, source, keys, time), "incremental"


def updated(target: DataFrame, values: dict[str, Column], where: Column) -> DataFrame:
    """UPDATE SET ... WHERE: a null condition changes nothing."""
    holds = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(holds, values[c]).otherwise(F.col(f"`{c}`")).cast(target.schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in target.columns))


def deleted(target: DataFrame, where: Column) -> DataFrame:
    """DELETE WHERE: rows whose condition is false or null stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def recompute_changed(target: DataFrame, detail: DataFrame, changed: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """A target of aggregates, with those keys computed anew that occur in the changes."""
    fresh = detail.join(changed.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(*aggregates)
    gone = changed.select(*keys).distinct()
    return target.join(gone, list(keys), "left_anti").select(*target.columns).unionByName(fresh.select(*target.columns))


def changes_between(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The change rows that lead from one state to another (keys unique in both; a null key is a value like others).

    One join of both sides."""
    columns = after.columns
    old = before.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("t"))
    new = after.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("s"))
    same = F.lit(True)
    for k in keys:
        same = same & t(k).eqNullSafe(s(k))
    said = lambda row, name: F.struct(F.col(row).alias("r"), F.lit(name).alias("k"))
    kinds = F.when(F.col("t").isNull(), F.array(said("s", INSERT))).when(F.col("s").isNull(), F.array(said("t", DELETE))).when(_differ(columns, keys), F.array(said("t", BEFORE), said("s", AFTER)))
    return old.join(new, same, "full_outer").select(F.explode(kinds).alias("x")).select("x.r.*", F.col("x.k").alias("_change_type"))


def _differ(columns: Sequence[str], keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        if c not in keys:
            out = out | ~t(c).eqNullSafe(s(c))
    return out


def replay(before: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after change rows with _commit_version, applied in that order."""
    newest = latest(changes.where(F.col("_change_type") != BEFORE), keys, "_commit_version")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    kept = before.alias("b").join(newest.select(*keys).alias("c"), same, "left_anti").select(*before.columns)
    return kept.unionByName(newest.where(F.col("_change_type") != DELETE).select(*before.columns))
