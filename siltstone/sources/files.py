"""Files that are loaded once, folders as tables, and exports under chosen names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str, format: str, schema: T.StructType | str | None = None, stream: bool = False, glob: str | None = None, file_name: bool = False, **options) -> DataFrame:
    """A folder as a batch or stream; `glob` filters file names, `file_name` adds the path as file_path."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format(format).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.withColumn("file_path", F.col("_metadata.file_path")) if file_name else df


LEDGER = "path string, length long, modificationTime timestamp, load_id string"


def copy_into(spark: SparkSession, path: str, target: str, format: str, columns: Sequence[Column | str] = ("*",), schema: T.StructType | str | None = None, force: bool = False, merge_schema: bool = False, glob: str | None = None, portion: int = 10_000, **options) -> int:
    """Append files of `path` that weren't loaded before to the Parquet table `target`; the number of files loaded.

    Files are taken in portions, each a load: its rows are written under a new load id, then its files to the ledger beside
    the table, which makes the load count (see loaded()). So a load that stops in between is as if it had not begun, and its
    files come with the next one. New files are an anti-join with the ledger; the driver holds the names of a portion.
    `force` loads all again. Without merge_schema, columns that the table lacks are an error; with it, they are added.
    """
    target = target.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        listed = listed.option("pathGlobFilter", glob)
    files = listed.load(path).select("path", "length", "modificationTime")
    known = _maybe(spark, f"{target}/_loaded", LEDGER)
    fresh = files if force or known is None else files.join(known.select("path"), "path", "left_anti")
    reader = spark.read.format(format).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    held, n = [], 0

    def put() -> None:
        rows = reader.load([r["path"] for r in held]).select(*columns)
        there = loaded(spark, target) if _maybe(spark, f"{target}/_loaded") is not None else None
        if there is not None and not merge_schema and (more := set(rows.columns) - set(there.columns)):
            raise ValueError(f"new columns: {sorted(more)}")
        load_id = uuid.uuid4().hex
        rows.write.parquet(f"{target}/data/load_id={load_id}")
        spark.createDataFrame([(*r, load_id) for r in held], LEDGER).coalesce(1).write.mode("append").parquet(f"{target}/_loaded")

    for r in fresh.toLocalIterator():
        held.append(r)
        n += 1
        if len(held) == portion:
            put()
            held.clear()
    if held:
        put()
    return n


def loaded(spark: SparkSession, target: str, loads: DataFrame | None = None) -> DataFrame:
    """The rows of a table of copy_into(): those of loads that are in the ledger, or of `loads` (load_id).

    The list of loads, one row for each run or portion of files, is broadcast; a shuffle would send all rows of a load to one
    task.
    """
    target = target.rstrip("/")
    counted = (spark.read.schema(LEDGER).parquet(f"{target}/_loaded") if loads is None else loads).select("load_id").distinct()
    data = spark.read.option("mergeSchema", "true").parquet(f"{target}/data").withColumn("load_id", F.col("load_id").cast("string"))
    return data.join(F.broadcast(counted), "load_id", "left_semi").drop("load_id")


def _maybe(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")).parquet(path)


def by_position(spark: SparkSession, path: str, ddl: str, sep: str = ",", header: bool = False, modified: str | None = "_last_modified_ts") -> DataFrame:
    """A delimited file whose columns are named by position from a DDL string."""
    df = spark.read.schema(ddl).option("sep", sep).option("header", str(header).lower()).option("enforceSchema", "true").csv(path)
    return df.withColumn(modified, F.current_timestamp()) if modified else df


def ingest_tasks(spark: SparkSession, tasks: DataFrame, root: str, target: str, ledger: bool = True) -> list[dict]:
    """Run ingest tasks from configuration rows (task_id, src_path, src_format, src_column_list, src_sep, src_header,
    bronze_table, silver_table, primary_key): files that weren't loaded before are appended to the bronze table by
    position, and the newest row of each key replaces that of the silver table. One row of counts for each task, with the
    folder of the silver table's newest state. A run that stopped anywhere is made up for by the next one.

    Tasks are configuration, tens of rows; the driver goes through them in the order of task_id.
    """
    said = []
    for r in tasks.orderBy("task_id").collect():
        bronze, silver = f"{target}/{r['bronze_table']}", f"{target}/{r['silver_table']}"
        keys = [k.strip() for k in r["primary_key"].split(",")]
        columns = ["*", F.current_timestamp().alias("_last_modified_ts")]
        n = copy_into(spark, f"{root}/{r['src_path']}", bronze, r["src_format"], columns, schema=r["src_column_list"], sep=r["src_sep"], header=bool(r["src_header"]), enforceSchema=True)
        said.append({"task_id": r["task_id"], "files": n, "silver": _catch_up(spark, bronze, silver, keys)})
    return said


APPLIED = "load_id string, state string, number long"


def _catch_up(spark: SparkSession, bronze: str, silver: str, keys: Sequence[str]) -> str | None:
    """Merge the loads of a bronze table that the silver one lacks; the folder of its newest state (None: nothing yet).

    What the silver table has is in its list of applied loads: a new state is written aside, then its loads are added to the
    list in one file, which makes it the newest. So it follows from the bronze table whatever stopped before, and loads that an
    earlier run left are made up for.
    """
    from ..operators.dedup import latest
    from ..operators.merge import upsert

    ledger, applied = _maybe(spark, f"{bronze}/_loaded", LEDGER), _maybe(spark, f"{silver}/_applied", APPLIED)
    newest = None if applied is None else applied.orderBy(F.desc("number")).first()
    if ledger is not None:
        missing = ledger.select("load_id").distinct()
        missing = missing if applied is None else missing.join(applied.select("load_id"), "load_id", "left_anti")
        ids = [x[0] for x in missing.collect()]  # loads, not files
        if ids:
            new = spark.createDataFrame([(i,) for i in ids], "load_id string")
            fresh = latest(loaded(spark, bronze, new), keys, "_last_modified_ts")
            state = fresh if newest is None else upsert(spark.read.parquet(newest["state"]), fresh, keys, check=False)
            path, number = f"{silver}/state-{uuid.uuid4().hex}", 0 if newest is None else newest["number"] + 1
            state.write.parquet(path)
            new.select("load_id", F.lit(path).alias("state"), F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(f"{silver}/_applied")
            return path
    return None if newest is None else newest["state"]


def kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options) -> DataFrame:
    """A topic as a stream of key, value (texts), topic, partition, offset, timestamp; needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).options(**options)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp")


def jdbc_query(spark: SparkSession, url: str, query: str, split: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """The rows of a query at another database; `split` (column, low, high, parts) reads it in parts at once."""
    if split is None:
        return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    column, low, high, parts = split
    many = {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**many, **options).load()


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_path, file_name, file_size, modified_time, parent_dir of all files below a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_time"))
    name = F.element_at(F.split("file_path", "/"), -1)
    return files.select("file_path", name.alias("file_name"), "file_size", "modified_time", F.expr("substring(file_path, 1, length(file_path) - length(element_at(split(file_path, '/'), -1)) - 1)").alias("parent_dir"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Files, bytes and mean size in MB of each folder, all it contains included."""
    parts = F.split("parent_dir", "/")
    up = files.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    return up.where("folder <> ''").groupBy("folder").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.round(F.avg("file_size") / (1 << 20), 4).alias("mean_mb"))


def move_files(moves: DataFrame) -> DataFrame:
    """Rename files by rows (source, destination), many at a time; a row with the result for each.

    For paths that every executor mounts. A row whose source is gone and whose destination exists counts as done, so a
    task that runs again does no harm.
    """

    def run(batches: Iterator) -> Iterator:
        import os

        for pdf in batches:
            said = []
            for a, b in zip(pdf["source"], pdf["destination"]):
                try:
                    if not os.path.exists(a) and os.path.exists(b):
                        said.append("SUCCESS")
                        continue
                    os.makedirs(os.path.dirname(b), exist_ok=True)
                    os.replace(a, b)
                    said.append("SUCCESS")
                except OSError as e:
                    said.append(f"FAIL: {e}")
            yield pdf.assign(result=said)

    return moves.select("source", "destination").mapInPandas(run, "source string, destination string, result string")


def with_bloom_filters(writer, columns: dict[str, int]):
    """A DataFrameWriter that adds Parquet bloom filters: {column: expected distinct values}."""
    for c, n in columns.items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(n))
    return writer
