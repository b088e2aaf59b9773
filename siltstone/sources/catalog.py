"""The session's catalog as rows, migration scripts, and generated data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_tables(spark: SparkSession, include: dict[str, Sequence[str]] | None = None, exclude: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """catalog_name, schema_name, table_name, table_type; include and exclude lists by those names; no temporary views."""
    rows = []
    for db in spark.catalog.listDatabases():
        rows += [(db.catalog or "spark_catalog", db.name, t.name, t.tableType) for t in spark.catalog.listTables(db.name) if not t.isTemporary]
    df = spark.createDataFrame(rows, "catalog_name string, schema_name string, table_name string, table_type string")
    for c, names in (include or {}).items():
        df = df.where(F.col(c).isin(list(names)))
    for c, names in (exclude or {}).items():
        df = df.where(~F.col(c).isin(list(names)))
    return df


def describe(spark: SparkSession, table: str) -> dict[str, str]:
    """The detail rows of DESCRIBE EXTENDED by name."""
    rows = [(r["col_name"], r["data_type"]) for r in spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:name)", args={"name": table}).collect()]
    start = next((i for i, r in enumerate(rows) if r[0] == "# Detailed Table Information"), len(rows))
    return {k: v for k, v in rows[start + 1 :] if k}


def table_profile(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """table_name, type, provider, location, size_bytes (null if statistics are missing) of some tables."""
    rows = []
    for t in tables:
        d = describe(spark, t)
        size = (d.get("Statistics") or "").split(" bytes")[0]
        rows.append((t, d.get("Type"), d.get("Provider"), d.get("Location"), int(size) if size.isdigit() else None))
    return spark.createDataFrame(rows, "table_name string, type string, provider string, location string, size_bytes long")


def table_class(type_: Column, location: Column, provider: Column) -> Column:
    """VIEW, MANAGED, EXTERNAL or OTHER."""
    t = F.upper(type_)
    return F.when(t.contains("VIEW"), "VIEW").when(t == "MANAGED", "MANAGED").when((t == "EXTERNAL") | (location.isNotNull() & provider.isNotNull()), "EXTERNAL").otherwise("OTHER")


def migration_scripts(tables: DataFrame, to_catalog: str, mounts: dict[str, str] | None = None) -> DataFrame:
    """Statements that make each table (schema_name, table_name, class, location, view_text) anew in another catalog:
    managed ones by a copy, external ones at their place (mount prefixes replaced), views from their own text."""
    place = F.col("location")
    for old, new in (mounts or {}).items():
        place = F.when(F.startswith(F.col("location"), F.lit(old)), F.concat(F.lit(new), F.substring("location", len(old) + 1, 10_000))).otherwise(place)
    source = F.concat_ws(".", "schema_name", "table_name")
    goal = F.concat_ws(".", F.lit(to_catalog), "schema_name", "table_name")
    return tables.select("schema_name", "table_name", (
        F.when(F.col("class") == "VIEW", F.concat(F.lit("CREATE OR REPLACE VIEW "), goal, F.lit(" AS "), F.col("view_text")))
        .when(F.col("class") == "EXTERNAL", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), goal, F.lit(" LIKE "), source, F.lit(" LOCATION '"), place, F.lit("'")))
        .when(F.col("class") == "MANAGED", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), goal, F.lit(" AS SELECT * FROM "), source))
    ).alias("statement"), F.when(F.col("class") == "VIEW", 2).otherwise(1).alias("step")).where(F.col("statement").isNotNull())


def synthetic_users(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    r = lambda k: F.rand(seed + k)
    return spark.range(n).select(F.col("id").alias("user_id"), F.concat(F.lit("user"), F.col("id")).alias("name"), (F.floor(r(1) * 60) + 18).cast("int").alias("age"), F.when(r(2) < 0.5, "F").otherwise("M").alias("gender"), F.round(r(3) * 100, 2).alias("risk"))


def synthetic_transactions(spark: SparkSession, n: int, users: int, start: str = "2024-01-01", days: int = 30, seed: int = 2) -> DataFrame:
    r = lambda k: F.rand(seed + k)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + F.floor(r(1) * days * 86400))
    return spark.range(n).select(F.col("id").alias("transaction_id"), F.floor(r(2) * users).cast("long").alias("user_id"), at.alias("ts"), F.round(r(3) * 500, 2).alias("amount"))


def synthetic_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 3) -> DataFrame:
    """JSON documents: nodes of three types, and relationships between them."""
    kind = F.element_at(F.array(F.lit("malware"), F.lit("indicator"), F.lit("identity")), (F.col("id") % 3 + 1).cast("int"))
    a = spark.range(nodes).select(F.to_json(F.struct(F.concat(kind, F.lit("--"), F.col("id")).alias("id"), kind.alias("type"))).alias("raw"))
    name = lambda c: F.concat(F.element_at(F.array(F.lit("malware"), F.lit("indicator"), F.lit("identity")), (c % 3 + 1).cast("int")), F.lit("--"), c)
    ends = spark.range(edges).select("id", F.floor(F.rand(seed) * nodes).cast("long").alias("s"), F.floor(F.rand(seed + 1) * nodes).cast("long").alias("t"))
    b = ends.select(F.to_json(F.struct(F.concat(F.lit("relationship--"), F.col("id")).alias("id"), F.lit("relationship").alias("type"), name(F.col("s")).alias("source_ref"), name(F.col("t")).alias("target_ref"), F.lit("uses").alias("relationship_type"))).alias("raw"))
    return a.unionByName(b)
