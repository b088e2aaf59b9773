"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Upper end of what a Python worker looks at in one go, in bytes of text.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{tag}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends here, and lost executors lose nothing.

    The folder stays, for what is returned may be read later; whoever owns `spark.checkpoint.dir` clears its folder
    `siltstone` when no result is in use. For what nothing returned depends on, see Scratch.
    """
    return _written(df, new_path(df.sparkSession, tag))


class Scratch:
    """As materialize(), but all folders go when the block ends: nothing that leaves it may depend on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, new_path(spark, "scratch"), 0

    def __enter__(self) -> "Scratch":
        return self

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.base}/{self.n}-{tag}")

    def __exit__(self, *_) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text each; a longer text makes a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield batch.slice(first)


def held_out() -> "F.Column":
    """True for the third of documents whose labels no model may see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def bounded_labels(labels: DataFrame, column: str, limit: int) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that models may learn from, about `limit` of them at most.

    Rows are kept by a hash of doc_id, so the choice does not depend on order or partitioning. Rows without a
    doc_id or label are of no use; of repeated doc_ids one row, with the larger label, is kept.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias("label"))
    )
    n = usable.count()
    if n > limit:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * limit / n))
    return usable
