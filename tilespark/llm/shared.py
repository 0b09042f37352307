"""Shared storage and small helpers for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words, for contracts that define them as runs of other characters.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs on one machine (tests), a temporary folder is used and recorded in the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("tilespark.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tilespark-")
        spark.conf.set("tilespark.shared.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tilespark/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str, of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage and survives lost executors.

    ``of`` names a written table that bounds its size: a file is then written for each MiB of that table at most, not for every partition. A file costs a
    local file system a process or more that sets its mode, started as a copy of the executor.
    """
    spark = df.sparkSession
    if of is not None and (files := 1 + (table_bytes(of) >> 20)) < partitions(spark):
        df = df.coalesce(files)
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, column: str) -> DataFrame:
    """As :func:`materialize`, in buckets by ``column``: later joins on it do not shuffle this side. The catalog keeps no entry of the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(partitions(spark), column).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of an external table only the entry goes
    return found


def remove(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete a table written by :func:`materialize` once nothing reads it any more."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    for p in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table written by :func:`materialize` (compressed Parquet)."""
    spark = df.sparkSession
    total = 0
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:  # a projection of it reads the same files
        target = spark._jvm.org.apache.hadoop.fs.Path(p)
        total += target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return total


def join_small(big: DataFrame, small: DataFrame, on, how: str, limit: int = 8 << 20) -> DataFrame:
    """Join with a materialised side: broadcast only when its measured size is within ``limit``, else by shuffle."""
    if table_bytes(small) <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def with_fields(df: DataFrame, carry: list[str], more: str) -> T.StructType:
    """The schema of ``carry`` as in ``df``, followed by the fields that ``more`` (DDL) declares; any name is possible."""
    return T.StructType([df.schema[c] for c in carry] + T.StructType.fromDDL(more).fields)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of documents are long: Python gets them ``rows`` at a time, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, and at its task's end what it freed goes back to the system: a Python worker serves many tasks and would keep it beside the executor's heap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return task
