"""Building an index in runs: what a run did is observed while it writes, kept beside the index, and compared when another run goes on."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tilespark.sources import corpus

REPORT = "model_id string, revision string, batch_size int, planned long, embedded_this_run long, embedded_total long, skipped_this_run long, skipped_total long, wall_s double, tiles_per_sec double, finished timestamp"


class OtherBatchSize(UserWarning):
    """The index was begun with another batch size, and vectors may differ in their last digits."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty where there is none yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def reports(spark: SparkSession, root: str) -> DataFrame:
    """The reports of all runs so far."""
    return _read(spark, f"{root}/reports", REPORT)


def build(planned: DataFrame, embed: Callable[[DataFrame, int], DataFrame], root: str, model_id: str, revision: str, batch_size: int = 256) -> dict:
    """One run over ``planned`` (``tile_id, nodata_fraction, ...``): embeds what earlier runs have not done and returns its report.

    ``embed(tiles, batch_size)`` gives ``tile_id, embedding``. Tiles that are nodata all over are written down as skipped, once. What the run did comes from
    ``DataFrame.observe`` while it writes; totals add what the files so far hold. A run that failed halfway left nothing visible and is simply run again; another model or
    revision is refused, another batch size is a warning.
    """
    spark = planned.sparkSession
    before = reports(spark, root).orderBy("finished").select("model_id", "revision", "batch_size").limit(1).collect()
    if before and (before[0]["model_id"], before[0]["revision"]) != (model_id, revision):
        raise corpus.BadCorpus(f"the index at {root} is of {before[0]['model_id']} {before[0]['revision']}, not of {model_id} {revision}")
    first = before[0]["batch_size"] if before else batch_size
    if first != batch_size:
        warnings.warn(f"the index at {root} was begun with batches of {first}, this run has {batch_size}: vectors may differ in their last digits", OtherBatchSize, stacklevel=2)
    embedded, skipped = _read(spark, f"{root}/vectors", "tile_id string, embedding array<float>"), _read(spark, f"{root}/skipped", "tile_id string")
    had = embedded.count(), skipped.count()  # of files already written, from their footers
    began = time.monotonic()
    all_, new, gone = Observation(), Observation(), Observation()
    left = corpus.todo(planned.observe(all_, F.count(F.lit(1)).alias("planned")), embedded.select("tile_id"), skipped)
    empty = F.col("nodata_fraction") >= 1.0
    left.filter(empty).select("tile_id").observe(gone, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{root}/skipped")
    rest = corpus.todo(planned, embedded.select("tile_id"), spark.createDataFrame([], "tile_id string")).filter(~empty)
    embed(rest, batch_size).select(F.col("tile_id").cast("string").alias("tile_id"), F.col("embedding").cast("array<float>").alias("embedding")).observe(new, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{root}/vectors")
    wall = time.monotonic() - began
    n, s = new.get["n"], gone.get["n"]
    report = {
        "model_id": model_id, "revision": revision, "batch_size": first, "planned": all_.get["planned"], "embedded_this_run": n, "embedded_total": had[0] + n, "skipped_this_run": s,
        "skipped_total": had[1] + s, "wall_s": wall, "tiles_per_sec": n / wall if wall > 0 else 0.0,
    }
    spark.createDataFrame([tuple(report.values())], REPORT.rsplit(", ", 1)[0]).withColumn("finished", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/reports")
    return report
