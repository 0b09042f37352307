"""Reading and writing the vector corpus, clips, inventories and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.vectors import has_bad_component, norm, normalised

VECTORS = "model_id string, revision string, aoi string, tile_id string, scale int, nodata_fraction double, embedding array<float>"

CLIP = (
    "meta struct<clip_id:string,query:string,fps:double,num_frames:int,width:int,height:int,labeled_frames:array<int>>, "
    "tracks array<struct<id:int,label:string,ignore:boolean,acquired_frame:int,boxes:map<string,array<double>>>>"
)


class BadCorpus(ValueError):
    """The corpus breaks a rule it was written under; nothing is repaired silently."""


def write_vectors(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors by model and area; Spark's commit makes a batch visible whole or not at all."""
    rows.write.mode(mode).partitionBy("model_id", "aoi").parquet(path)


def read_vectors(spark: SparkSession, path: str, model_id: str | None = None, areas: list[str] | None = None, renormalise: bool = True) -> DataFrame:
    """Checked vectors of a model and some areas; both filters prune partitions."""
    rows = spark.read.schema(VECTORS).parquet(path)
    if model_id is not None:
        rows = rows.filter(F.col("model_id") == model_id)
    if areas is not None:
        known = {r[0] for r in rows.select("aoi").distinct().collect()}
        if missing := sorted(set(areas) - known):
            raise BadCorpus(f"no index for {missing}")
        rows = rows.filter(F.col("aoi").isin(areas))
    checked(rows)
    return rows.withColumn("embedding", normalised(F.col("embedding"))) if renormalise else rows


def problems(rows: DataFrame) -> DataFrame:
    """Vectors that are not finite, or whose norm is off by more than 0.01: ``tile_id, problem``."""
    n = norm(F.col("embedding"))
    kind = F.when(has_bad_component(F.col("embedding")), "not_finite").when(F.abs(n - 1.0) > 1e-2, "norm")
    return rows.select("tile_id", kind.alias("problem")).filter("problem IS NOT NULL")


def checked(rows: DataFrame) -> None:
    """Raises unless vectors are finite unit vectors of one model and revision, with the same scales in every area."""
    bad = problems(rows).orderBy("problem", "tile_id").limit(5).collect()
    if bad:
        raise BadCorpus("bad vectors: " + ", ".join(f"{r['tile_id']} ({r['problem']})" for r in bad))
    if rows.select("model_id", "revision").distinct().limit(2).count() > 1:
        raise BadCorpus("more than one model or revision")
    if rows.groupBy("aoi").agg(F.array_sort(F.collect_set("scale")).alias("s")).select("s").distinct().limit(2).count() > 1:
        raise BadCorpus("areas have different scales")


def todo(planned: DataFrame, embedded: DataFrame, skipped: DataFrame) -> DataFrame:
    """Planned tiles that are neither embedded nor skipped: what a resumed run has left to do."""
    return planned.join(embedded, "tile_id", "left_anti").join(skipped, "tile_id", "left_anti")


def read_clips(spark: SparkSession, path: str, side: str) -> DataFrame:
    """Boxes of clip files (JSON): one row per track and frame; a missing acquisition frame is the track's first."""
    raw = spark.read.schema(CLIP).json(path, multiLine=True)
    clip = F.coalesce("meta.clip_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    each = raw.select(clip.alias("clip_id"), "meta.labeled_frames", F.explode("tracks").alias("t"))
    rows = each.select("clip_id", "labeled_frames", "t.*").withColumn("_first", F.array_min(F.transform(F.map_keys("boxes"), lambda k: k.cast("int"))))
    boxes = rows.select(
        "clip_id", F.lit(side).alias("side"), F.col("id").alias("track_id"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("ignore", F.lit(False)).alias("ignore"),
        F.coalesce("acquired_frame", "_first", F.lit(0)).alias("acquired_frame"), "labeled_frames", F.explode("boxes").alias("k", "b"),
    )
    xy = [F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return boxes.select("clip_id", "side", "track_id", "label", "ignore", "acquired_frame", "labeled_frames", F.col("k").cast("int").alias("frame"), *xy)


def read_clip_table(spark: SparkSession, path: str) -> DataFrame:
    """A row of each clip file, with tracks or without: ``clip_id, file, query, fps, num_frames, frames`` (labelled frames, null where none are declared)."""
    raw = spark.read.schema(CLIP).json(path, multiLine=True)
    declared = F.array_sort(F.array_distinct("meta.labeled_frames"))
    clip = F.coalesce("meta.clip_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return raw.select(clip.alias("clip_id"), F.input_file_name().alias("file"), F.coalesce("meta.query", F.lit("")).alias("query"), F.coalesce("meta.fps", F.lit(0.0)).alias("fps"), "meta.num_frames", F.when(F.size(declared) > 0, declared).alias("frames"))


def read_clip_tracks(spark: SparkSession, path: str, side: str) -> DataFrame:
    """A row of each track of clip files, with boxes or without: ``clip_id, side, track_id, label, ignore, acquired_frame``."""
    raw = spark.read.schema(CLIP).json(path, multiLine=True)
    clip = F.coalesce("meta.clip_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = raw.select(clip.alias("clip_id"), F.explode("tracks").alias("t"))
    first = F.array_min(F.transform(F.map_keys("t.boxes"), lambda k: k.cast("int")))
    return rows.select("clip_id", F.lit(side).alias("side"), F.col("t.id").alias("track_id"), F.coalesce("t.label", F.lit("")).alias("label"), F.coalesce("t.ignore", F.lit(False)).alias("ignore"), F.coalesce("t.acquired_frame", first, F.lit(0)).alias("acquired_frame"))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder: path, size, time of change; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def tagged_block(pages: DataFrame, html: str, name: str) -> DataFrame:
    """The first block between ``<name ...>`` and its end tag."""
    return pages.withColumn("block", F.regexp_extract(html, f"(?s)<{name}[^>]*>(.*?)</{name}>", 1))
