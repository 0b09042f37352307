"""What is built once and loaded again: the located corpus, the compact export, background scores; each load checks what it reads.

Everything is Parquet below a root that the caller allows. A load never repairs: it raises with the first few offenders.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.operators import export, ranking
from tilespark.sources.corpus import BadCorpus, read_vectors
from tilespark.sources.sinks import guarded


class MissingTiles(BadCorpus):
    """Vectors whose tiles no plan has, or a catalogue that lists vectors which are not there."""


class BadExport(ValueError):
    """An export that is not what it says it is, or not of the corpus it is measured against."""


def _first(rows: DataFrame, column: str, n: int = 5) -> list:
    return [r[0] for r in rows.select(column).orderBy(column).limit(n).collect()]


def located(vectors: DataFrame, plan: DataFrame) -> DataFrame:
    """Vectors with the box, source, date and ground resolution of their tiles (``plan``: tile_id and those); a tile that no plan has is an error."""
    if missing := _first(vectors.join(plan, "tile_id", "left_anti"), "tile_id"):
        raise MissingTiles(f"no plan has {missing}")
    return vectors.join(plan.drop("aoi", "scale"), "tile_id")


def load_corpus(spark: SparkSession, path: str, plan: DataFrame, model_id: str, areas: list[str] | None = None) -> DataFrame:
    """One model's vectors of one or several areas, checked and located; several areas have to share model, revision and scales."""
    if areas is not None and not areas:
        raise BadCorpus("no areas given")
    return located(read_vectors(spark, path, model_id, areas), plan)


def ground_extents(corpus: DataFrame) -> DataFrame:
    """``scale, extent_m, areas, differ``: a tile's true side. Within an area the sources' resolutions count alike; over areas, the areas' tiles are the weights."""
    per_source = corpus.groupBy("aoi", "scale", "source").agg(F.first("gsd_m").alias("gsd_m"), F.count(F.lit(1)).alias("n"))
    per_area = per_source.groupBy("aoi", "scale").agg((F.avg("gsd_m") * F.col("scale")).alias("extent_m"), F.sum("n").alias("n"))
    return per_area.groupBy("scale").agg(
        F.round(F.sum(F.col("extent_m") * F.col("n")) / F.sum("n"), 6).alias("extent_m"), F.count(F.lit(1)).alias("areas"), (F.countDistinct(F.round("extent_m", 6)) > 1).alias("differ")
    )


def resumed(listed: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors a resumed run goes on from: those that its catalogue lists. Vectors beyond it are left out (a run ended between two writes);
    a listed tile without a vector is an error."""
    if missing := _first(listed.join(vectors, "tile_id", "left_anti"), "tile_id"):
        raise MissingTiles(f"listed, but without a vector: {missing}")
    return vectors.join(listed.select("tile_id"), "tile_id", "left_semi")


# the compact export


def build_export(vectors: DataFrame, path: str, root: str, dim: int | None = None) -> None:
    """Codes of ``vectors`` (tile_id, scale, embedding, model_id, revision, aoi) in a basis of ``dim`` directions (none: their own), with what loading checks."""
    spark, target = vectors.sparkSession, guarded(path, root)
    rows = vectors.select("tile_id", "scale", "embedding")
    components = None
    if dim is not None:
        components = export.basis(vectors, dim)
        rows = export.in_basis(rows, components)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(components)], "at int, direction array<double>").coalesce(1).write.mode("overwrite").parquet(f"{target}/basis")
    export.coded(rows).drop("embedding").write.mode("overwrite").parquet(f"{target}/codes")
    codes = spark.read.parquet(f"{target}/codes")  # what was written is what is described
    width = vectors.select(F.size("embedding").alias("dim")).limit(1)
    about = vectors.groupBy().agg(F.first("model_id").alias("model_id"), F.first("revision").alias("revision"), F.countDistinct("model_id", "revision").alias("models")).crossJoin(width)
    described = about.crossJoin(codes.agg(F.count(F.lit(1)).alias("tiles"), F.max(F.size("codes")).alias("export_dim"), F.max("scale_").alias("int8_scale"))).withColumn("projected", F.lit(dim is not None))
    described.coalesce(1).write.mode("overwrite").parquet(f"{target}/about")


def load_export(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray | None, dict]:
    """Codes, basis and description; counts and dimensions have to be those that were written down."""
    about = spark.read.parquet(f"{path}/about").collect()[0].asDict()
    codes = spark.read.parquet(f"{path}/codes")
    found = codes.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("codes")).alias("least"), F.max(F.size("codes")).alias("most"), F.countDistinct("tile_id").alias("ids")).collect()[0]
    if about["models"] != 1:
        raise BadExport("more than one model or revision")
    if found["n"] != about["tiles"] or found["ids"] != about["tiles"]:
        raise BadExport(f"{about['tiles']} tiles written down, {found['n']} rows of {found['ids']} tiles found")
    if {found["least"], found["most"]} != {about["export_dim"]}:
        raise BadExport(f"codes of {found['least']} to {found['most']} numbers, {about['export_dim']} written down")
    basis = None
    if about["projected"]:
        rows = spark.read.parquet(f"{path}/basis").orderBy("at").collect()  # a direction a row
        basis = np.array([r["direction"] for r in rows])
        if basis.shape != (about["export_dim"], about["dim"]):
            raise BadExport(f"a basis of {basis.shape}, {(about['export_dim'], about['dim'])} written down")
    return codes, basis, about


def check_current(codes: DataFrame, vectors: DataFrame) -> None:
    """Raises unless the export has exactly the corpus's tiles."""
    lost = _first(vectors.join(codes, "tile_id", "left_anti"), "tile_id")
    extra = _first(codes.join(vectors, "tile_id", "left_anti"), "tile_id")
    if lost or extra:
        raise BadExport(f"stale: without {lost}, with {extra}")


def measured_overlap(vectors: DataFrame, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """``scale, queries, mean_overlap`` of the export loaded from ``path``, and a row without scale: the mean of the scales' means."""
    codes, basis, _ = load_export(vectors.sparkSession, path)
    check_current(codes, vectors)
    ident = F.xxhash64("tile_id").alias("vec_id")  # ties need an order, not a name
    asked = queries if basis is None else export.in_basis(queries, basis)
    full = ranking.top_by_matrix(vectors.select(ident, "scale", "embedding"), queries, k)
    small = ranking.top_by_matrix(export.decoded(codes).select(ident, "scale", "embedding"), asked, k)
    per_scale = export.overlap(full, small, k).groupBy("scale").agg(F.count(F.lit(1)).alias("queries"), F.avg("overlap").alias("mean_overlap"))
    overall = per_scale.agg(F.lit(None).cast("int").alias("scale"), F.max("queries").alias("queries"), F.avg("mean_overlap").alias("mean_overlap"))
    return per_scale.unionByName(overall).withColumn("mean_overlap", F.round("mean_overlap", 6))


# background scores


def build_background(corpora: dict[str, DataFrame], queries: DataFrame, path: str, root: str) -> None:
    """Best score of each background query per model, area and scale, over full-precision vectors; models are kept apart by partition and never mixed."""
    best = lambda m, c: ranking.scored(c, queries, ["aoi", "scale"]).groupBy("query_id", "aoi", "scale").agg(F.max("score").alias("top1")).withColumn("model_id", F.lit(m))
    rows = reduce(DataFrame.unionByName, [best(m, c) for m, c in sorted(corpora.items())])
    rows.write.mode("overwrite").partitionBy("model_id", "aoi").parquet(guarded(path, root))


def load_background(spark: SparkSession, path: str, model_id: str, areas: list[str] | None = None) -> DataFrame:
    """``query_id, scale, top1, aoi`` of one model; a model or area without scores is an error, not an empty set."""
    rows = spark.read.schema("query_id long, scale int, top1 double, model_id string, aoi string").parquet(path).filter(F.col("model_id") == model_id).drop("model_id")
    known = {r[0] for r in rows.select("aoi").distinct().collect()}
    if not known:
        raise BadCorpus(f"no background of {model_id}")
    if missing := sorted(set(areas or []) - known):
        raise BadCorpus(f"no background of {model_id} for {missing}")
    return rows if areas is None else rows.filter(F.col("aoi").isin(areas))
