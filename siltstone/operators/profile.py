"""Which columns queries use, how, and what that costs; where to go on reading a history."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clauses that give a column its role, as patterns of the text after their keyword.
CLAUSES = {
    "is_filter": r"(?is)\bwhere\b(.*?)(?:\bgroup\s+by\b|\border\s+by\b|\bhaving\b|\blimit\b|\bunion\b|\bwhen\b|$)",
    "is_join": r"(?is)\bon\b(.*?)(?:\bwhere\b|\bjoin\b|\bgroup\s+by\b|\border\s+by\b|\bwhen\b|\blimit\b|$)",
    "is_group": r"(?is)\bgroup\s+by\b(.*?)(?:\border\s+by\b|\bhaving\b|\blimit\b|\bunion\b|$)",
}


def summaries(history: DataFrame, since: datetime | None = None) -> DataFrame:
    """query_text, runs, mean_ms, total_ms of finished statements, by text."""
    rows = history.where(F.col("query_text").isNotNull())
    rows = rows.where(F.col("start") >= F.lit(since)) if since else rows
    return rows.groupBy(F.sha2("query_text", 256).alias("query_hash")).agg(F.first("query_text").alias("query_text"), F.count("*").alias("runs"), F.avg("duration_ms").alias("mean_ms"), F.sum("duration_ms").alias("total_ms"))


def column_roles(queries: DataFrame, columns: DataFrame) -> DataFrame:
    """query_hash, table_name, column_name and the roles that the text gives the column.

    Words of the clauses are exploded and joined with the catalogue's columns (table_name, column_name) of tables whose
    name the text holds: equi-joins both. A word that is qualified by another table's name or alias still counts, as
    texts are not resolved.
    """
    marked = queries.select("query_hash", F.lower("query_text").alias("text"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))
    parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(1)), " ").alias("part")) for role, p in CLAUSES.items()]
    used = marked.select("query_hash", F.explode(F.array(*parts)).alias("p")).select("query_hash", "p.role", F.explode(words(F.col("p.part"))).alias("word"))
    tables = marked.select("query_hash", F.explode(words(F.col("text"))).alias("table_word"))
    known = columns.select("table_name", F.lower(F.element_at(F.split("table_name", r"\."), -1)).alias("table_word"), "column_name", F.lower("column_name").alias("word"))
    found = used.join(known, "word").join(tables, ["query_hash", "table_word"])
    return found.groupBy("query_hash", "table_name", "column_name").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in CLAUSES))


def column_usage(roles: DataFrame, queries: DataFrame) -> DataFrame:
    """For each column the queries that use it, their runs and time, and how often in each role."""
    joined = roles.join(queries.select("query_hash", "runs", "total_ms"), "query_hash")
    return joined.groupBy("table_name", "column_name").agg(F.count_distinct("query_hash").alias("queries"), F.sum("runs").alias("runs"), F.sum("total_ms").alias("total_ms"), *(F.sum(r).alias(r) for r in CLAUSES))


def merge_predicates(operations: DataFrame, columns: DataFrame) -> DataFrame:
    """How many merges, updates and deletes of a table's history (table_name, version, predicate, duration_ms) name each
    of its columns, and their mean time."""
    words = operations.where(F.col("predicate").isNotNull()).select("table_name", "version", "duration_ms", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("predicate"), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))).alias("word"))
    known = columns.select("table_name", "column_name", F.lower("column_name").alias("word"))
    return words.join(known, ["table_name", "word"]).groupBy("table_name", "column_name").agg(F.count_distinct("version").alias("writes"), F.avg("duration_ms").alias("mean_ms"))


def _grams(text: Column, size: int) -> Column:
    """The distinct stretches of `size` characters; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def mentions(text: DataFrame, names: DataFrame, name: str = "name", column: str = "text", size: int = 3, broadcast_names: int = 50_000) -> DataFrame:
    """Rows whose text contains a name, in any case, with that name's row; a pair for each.

    Each name is looked up by one stretch of `size` characters (shorter names by themselves), the one that fewest names have;
    texts are cut into such stretches and joined on them, and then the whole name is compared: no row meets a name with which
    it shares nothing. Up to `broadcast_names` names, which are counted, that happens where the text is read. More of them are
    joined by shuffles, in which only numbers of rows and stretches travel, and frequent stretches are salted. Null texts and
    null or empty names match nothing; equal names are found each. Columns of both sides need different names.
    """
    from ..session import written
    from .skew import salted_join

    wanted = names.select(F.lower(name).alias("__name")).where("__name <> ''").distinct()
    parts = wanted.select("__name", F.least(F.length("__name"), F.lit(size)).alias("__size"))
    cut = F.coalesce(*(F.when(F.col("__size") == n, _grams(F.col("__name"), n)) for n in range(1, size + 1)))
    held = parts.select("__name", "__size", F.explode(cut).alias("__gram"))
    often = held.groupBy("__size", "__gram").agg(F.count("*").alias("__n"))
    index = held.join(often, ["__size", "__gram"]).groupBy("__name").agg(F.min(F.struct("__n", "__gram", "__size")).alias("g")).select("__name", "g.__gram", "g.__size")
    index = written(index, "names")
    sizes = sorted(r[0] for r in index.select("__size").distinct().collect())  # `size` at most
    few = names.count() <= broadcast_names
    rows = text if few else written(text.withColumn("__row", F.monotonically_increasing_id()), "texts")
    lowered = rows.withColumn("__text", F.lower(column)) if few else rows.select("__row", F.lower(column).alias("__text"))
    marked = lambda n: F.transform(_grams(F.col("__text"), n), lambda g: F.struct(F.lit(n).alias("s"), g.alias("g")))
    grams = F.flatten(F.array(*map(marked, sizes))) if sizes else F.expr("array(struct(0 AS s, '' AS g))")
    cut = lowered.withColumn("__g", F.explode(grams)).withColumns({"__size": F.col("__g.s"), "__gram": F.col("__g.g")}).drop("__g")
    if few:
        found = cut.join(F.broadcast(index), ["__size", "__gram"]).where(F.contains("__text", "__name"))
    else:
        pairs = salted_join(written(cut.drop("__text"), "stretches"), index, ["__size", "__gram"]).select("__row", "__name")
        found = written(rows.join(pairs, "__row").where(F.contains(F.lower(column), F.col("__name"))), "found")
    named = names.withColumn("__name", F.lower(name))
    both = found.join(F.broadcast(named), "__name") if few else salted_join(found, named, ["__name"])
    return both.select(*text.columns, *names.columns)


def resume_from(history: DataFrame, look_back: timedelta, now: datetime, start: str = "start", status: str = "status") -> datetime:
    """Where to read on: at the oldest statement still pending, else at the newest known, else `look_back` before now."""
    pending = F.upper(status).isin("QUEUED", "RUNNING", "STARTED")
    row = history.agg(F.min(F.when(pending, F.col(start))).alias("pending"), F.max(start).alias("newest")).first()
    return row["pending"] or row["newest"] or now - look_back


def poll(step: Callable[[int], bool], most: int, wait: Callable[[float], None], seconds: float = 5.0, most_errors: int = 3) -> int:
    """Call step(i) until it returns False, `most` times at most; errors in a row beyond the ceiling are raised."""
    errors = 0
    for i in range(most):
        try:
            if not step(i):
                return i + 1
            errors = 0
        except Exception:
            errors += 1
            if errors > most_errors:
                raise
        wait(seconds)
    return most


def balanced_groups(items: DataFrame, size: int, order: Column) -> DataFrame:
    """Groups of `size` items each by an order without ties, for dealing configuration rows (hundreds) to jobs."""
    from pyspark.sql import Window

    return items.withColumn("group_number", F.ceil(F.row_number().over(Window.orderBy(order)) / size))
