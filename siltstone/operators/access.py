"""Who may and does use what: privileges, tags, access history, lineage. All inputs are metadata frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import access_kind

OBJECT = ("object_type", "catalog_name", "schema_name", "table_name", "object_name")


def privileges(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of privileges of all kinds of objects ({object type: frame}); columns that a kind lacks are null."""
    out = None
    for kind, df in parts.items():
        columns = {c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in (*OBJECT[1:], "grantor", "grantee", "privilege_type", "inherited_from")}
        rows = df.select(F.lit(kind).alias("object_type"), *(c.alias(n) for n, c in columns.items()))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("access", access_kind(F.col("privilege_type")))


def effective(grants: DataFrame, members: DataFrame, user: str = "user_name", group: str = "group_name") -> DataFrame:
    """Grants of each user, of their own or through a group: two equi-joins instead of one on an OR."""
    users = members.select(user).distinct()
    own = grants.join(users, grants["grantee"] == users[user]).withColumn("through", F.lit("user"))
    through = grants.join(members.select(user, group).distinct(), grants["grantee"] == F.col(group)).withColumn("through", F.col(group)).drop(group)
    return own.unionByName(through.select(*own.columns)).distinct()


def access_history(events: DataFrame, keys: Sequence[str], time: str = "event_time", event: str = "event_id") -> DataFrame:
    return events.groupBy(*keys).agg(F.count_distinct(event).alias("events"), F.min(time).alias("first_access"), F.max(time).alias("last_access"))


def all_tags(parts: Sequence[DataFrame]) -> DataFrame:
    """Tags of catalogs, schemas, tables and columns in one table; name columns that a level lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def inherited_tags(objects: DataFrame, tags: DataFrame, name: str = "full_name") -> DataFrame:
    """Each object with the tags of itself and all it lies in (names a.b.c): ancestors are exploded, so it is an equi-join."""
    parts = F.split(F.col(name), r"\.")
    up = objects.withColumn("__up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))))
    joined = up.join(tags.select(F.col(name).alias("__up"), "tag_name", "tag_value"), "__up", "left")
    tag = F.when(F.col("tag_name").isNotNull(), F.concat_ws("=", "tag_name", "tag_value"))
    return joined.groupBy(*objects.columns).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


def related_objects(lineage: DataFrame, tables: DataFrame, name: str) -> DataFrame:
    """Tables directly up and down stream of `name`, and whether they still exist."""
    up = lineage.where(F.col("target_table_full_name") == name).select(F.lit("upstream").alias("direction"), F.col("source_table_full_name").alias("full_name"))
    down = lineage.where(F.col("source_table_full_name") == name).select(F.lit("downstream").alias("direction"), F.col("target_table_full_name").alias("full_name"))
    known = tables.select(F.col("full_name"), F.lit(True).alias("exists"))
    return up.unionByName(down).where("full_name is not null").distinct().join(known, "full_name", "left").select("direction", "full_name", F.coalesce("exists", F.lit(False)).alias("exists"))


def column_usage(lineage: DataFrame) -> DataFrame:
    """How often, by how many users and when last each source column was read."""
    return lineage.groupBy("source_table_full_name", "source_column_name").agg(F.count("*").alias("reads"), F.count_distinct("created_by").alias("users"), F.max("event_time").alias("last_read"))


def similar_columns(columns: DataFrame, name: str) -> DataFrame:
    """Columns whose name contains, or is contained in, `name`."""
    c, n = F.lower("column_name"), F.lit(name.lower())
    return columns.where(F.contains(c, n) | F.contains(n, c))
