"""Choosing and writing a table's layout: column statistics, scores, commands, clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GB = 1 << 30
#: The largest table size in GB, and the target file size in MB for tables up to it.
FILE_SIZES = [
    (8, 16), (16, 32), (32, 64), (64, 64), (128, 128), (256, 128), (512, 256), (1024, 256), (2560, 512), (3072, 716), (5120, 1024), (7168, 1024), (10240, 1024), (51200, 1024), (102400, 1024),
    (204800, 1024), (409600, 1024), (819200, 1024), (1638400, 2048),
]


def sample_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """`n` rows chosen by a seeded hash of a unique key: the same ones at every run, however the table is partitioned."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def min_max_scaled(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A column cScaled from 0 to 1 within each group for each c; 0 where all values are equal."""
    bounds = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(f"__bounds_{c}") for c in columns))
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        joined = df.join(bounds, same)
    else:
        joined = df.crossJoin(F.broadcast(bounds))  # one row

    def scaled(c: str) -> Column:
        low, high = F.col(f"__bounds_{c}.low"), F.col(f"__bounds_{c}.high")
        return F.coalesce(F.try_divide((F.col(c) - low).cast("double"), (high - low).cast("double")), F.lit(0.0))

    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *(scaled(c).alias(f"{c}Scaled") for c in columns))


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """column_name, distinct_count, row_count, share, in one aggregation over all rows."""
    columns = list(columns or df.columns)
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(F.count("*").alias("row_count"), *(count(c).alias(c) for c in columns))
    long = wide.unpivot(["row_count"], columns, "column_name", "distinct_count")
    return long.select("column_name", "distinct_count", "row_count", F.round(F.try_divide(F.col("distinct_count").cast("double"), F.col("row_count").cast("double")), 6).alias("share"))


def file_size_mb(size_bytes: Column) -> Column:
    """Target file size for a table's size; beyond the last band, null."""
    out = F.lit(None).cast("int")
    for up_to, mb in reversed(FILE_SIZES):
        out = F.when((size_bytes / GB).cast("long") <= up_to, mb).otherwise(out)
    return out


def layout_scores(columns: DataFrame, read_weight: float = 1.0, write_weight: float = 1.0) -> DataFrame:
    """Score and rank of columns as clustering keys (table_name, column_name, reads, writes, scaled_metrics, role_flags,
    share, distinct_count, row_count, is_partition): reads count by their weight and roles, both by how selective the
    column is. Kept are ranks 1 and 2 with 1000 distinct values or more, and selective columns."""
    selective = F.lit(0.001) + F.col("share")
    score = F.lit(read_weight) * F.col("reads") * (1 + F.col("scaled_metrics") + F.col("role_flags")) * selective + F.lit(write_weight) * F.col("writes") * selective
    ranked = columns.where(~F.col("is_partition")).withColumn("score", F.round(score, 6)).withColumn("rank", F.rank().over(Window.partitionBy("table_name").orderBy(F.desc("score"))).cast("long"))
    many = F.col("distinct_count") >= 1000
    keep = ((F.col("rank") <= 2) & many) | ((F.col("share") >= 0.2) & many) | ((F.col("share") >= 0.01) & (F.col("row_count") >= 1_000_000))
    return ranked.withColumn("chosen", keep)


def commands(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """table_name and the statements of its strategy, as text: cluster, properties, statistics."""
    keys = scores.where("chosen").groupBy("table_name").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "column_name"))), 1, 4), lambda x: x["column_name"]), ", ").alias("keys"))
    t = F.col("table_name")
    few = F.col("size_bytes") <= 100 * GB
    return sizes.join(keys, "table_name", "left").select(
        t, F.when(F.col("keys").isNotNull(), F.concat(F.lit("OPTIMIZE "), t, F.lit(" ZORDER BY ("), F.col("keys"), F.lit(")"))).otherwise(F.concat(F.lit("OPTIMIZE "), t)).alias("optimize"),
        F.concat(F.lit("ALTER TABLE "), t, F.lit(" SET TBLPROPERTIES ('target_file_size_mb' = '"), file_size_mb(F.col("size_bytes")).cast("string"), F.lit("')")).alias("properties"),
        F.concat(F.lit("ANALYZE TABLE "), t, F.lit(" COMPUTE STATISTICS FOR "), F.when(few | F.col("keys").isNull(), F.lit("ALL COLUMNS")).otherwise(F.concat(F.lit("COLUMNS "), F.col("keys")))).alias("analyze"),
    )


def run_commands(runner, tables: DataFrame, kinds: Sequence[str] = ("optimize", "properties", "analyze"), most: int = 4) -> list[dict]:
    """Run the statements that commands() gave (a row a table), table by table in order of kind, `most` tables at once; the
    status of each. A statement that fails stops those of its table alone."""
    from ..sources.paged import in_parallel, run_script

    def work(row) -> list[dict]:
        return [{"table_name": row["table_name"], **x} for x in run_script(runner, ";\n".join(row[k] for k in kinds if row[k]))]

    rows = tables.orderBy("table_name").collect()
    return [x for r in in_parallel(rows, work, most) for x in r]


def z_value(columns: Sequence[Column], bits: int = 10) -> Column:
    """Interleaved bits of columns that hold bucket numbers from 0 to 2^bits - 1."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(columns):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(columns) + i))
    return out


def clustered(df: DataFrame, columns: Sequence[str], bits: int = 8, files: int | None = None) -> DataFrame:
    """df dealt out and sorted so that each file holds a small range of all `columns` (a Z-order for several).

    Bucket numbers come from approximate quantiles, so skewed values spread evenly; ranges are Spark's own.
    """
    if len(columns) == 1:
        key = F.col(columns[0])
        dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
        return dealt.sortWithinPartitions(*columns)
    n = 1 << bits
    cuts = df.agg(*(F.percentile_approx(c, [i / n for i in range(1, n)], 10_000).alias(c) for c in columns)).first()
    buckets = [_bucket(c, sorted(set(cuts[c] or []))) for c in columns]
    with_z = df.withColumn("__z", z_value(buckets, bits))
    dealt = with_z.repartitionByRange(files, "__z") if files else with_z.repartitionByRange("__z")
    return dealt.sortWithinPartitions("__z").drop("__z")


def _bucket(column: str, marks: list) -> Column:
    if not marks:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(m) for m in marks)), lambda m: m <= F.col(column))), F.lit(0))


def file_ranges(spark, path: str, columns: Sequence[str], format: str = "parquet") -> DataFrame:
    """file_path, rows, and the least and largest value of each column (`min_<c>`, `max_<c>`) of a folder's files."""
    df = spark.read.format(format).load(path)
    bounds = [x for c in columns for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("rows"), *bounds)


def overlap_depth(ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, files, mean_depth, max_depth: how many files' ranges lie over a place, at the ends of all ranges.

    A sweep over starts and ends, one or two rows a file. Depth 1 means that a value is in one file; files without values of
    a column aren't counted for it. Running counts go over the listing of files, which is metadata (one task a column).
    """
    out = None
    for c in columns:
        low, high = F.struct(F.col(f"min_{c}").alias("v"), F.lit(0).alias("end")), F.struct(F.col(f"max_{c}").alias("v"), F.lit(1).alias("end"))
        marks = ranges.where(F.col(f"min_{c}").isNotNull()).select(F.explode(F.array(low, high)).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
        w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # at the start of a range those that end there still lie over it
        depth = marks.withColumn("depth", F.sum(F.when(F.col("m.end") == 0, F.col("n")).otherwise(-F.col("n"))).over(w) + F.when(F.col("m.end") == 1, F.col("n")).otherwise(0))
        one = depth.agg(F.sum(F.when(F.col("m.end") == 0, F.col("n"))).alias("files"), F.round(F.sum(F.col("depth") * F.col("n")) / F.sum("n"), 6).alias("mean_depth"), F.max("depth").alias("max_depth")).select(F.lit(c).alias("column_name"), F.coalesce("files", F.lit(0)).alias("files"), "mean_depth", "max_depth")
        out = one if out is None else out.unionByName(one)
    return out


def files_read(ranges: DataFrame, column: str, wanted: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """The rows of `wanted` (ranges of values, both ends included) with how many files could hold such values, and all files.

    Files and predicates meet where a predicate's range and a file's overlap; there are few predicates, which are counted.
    """
    rows = wanted.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("pass predicates, not data")
    spark, files = ranges.sparkSession, ranges.select(F.col(f"min_{column}").alias("__min"), F.col(f"max_{column}").alias("__max"))
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("__w", T.LongType()), *wanted.schema.fields]))
    hit = files.join(F.broadcast(numbered), (F.col("__min") <= F.col(high)) & (F.col(low) <= F.col("__max"))).groupBy("__w").agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("files"))
    return numbered.join(hit, "__w", "left").crossJoin(total).select(*wanted.columns, F.coalesce("n", F.lit(0)).alias("files_read"), "files")
