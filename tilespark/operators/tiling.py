"""Tile plans of rasters and of frames, as generators over rows of headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as g

SCALES = (448, 224, 112)


def tile_plan(scenes: DataFrame, scales: tuple[int, ...] = SCALES, limit: int | None = None) -> DataFrame:
    """Every (scene, scale, row, col), padded at the right and bottom edge; ``scenes`` has scene_id, width, height, aoi, acq_date.

    With ``limit``, the first so many in the order (area, scale descending, scene, row, column); see :func:`ordered`.
    """
    if limit is not None:
        return ordered(_plan(scenes, scales, "aoi")).limit(limit).drop("aoi")
    return _plan(scenes, scales)


def ordered(plan: DataFrame) -> DataFrame:
    """A plan (with ``aoi``) in the order in which tiles are embedded: larger tiles first, then scenes, row by row."""
    return plan.orderBy("aoi", F.desc("scale"), "scene_id", "row_", "col")


def _plan(scenes: DataFrame, scales: tuple[int, ...], *more: str) -> DataFrame:
    each = scenes.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    rows = each.withColumn("row_", F.explode(F.sequence(F.lit(0), g.planned(F.col("height"), F.col("scale")) - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), g.planned(F.col("width"), F.col("scale")) - 1)))
    w, h = g.valid_length(F.col("width"), F.col("scale"), F.col("col")), g.valid_length(F.col("height"), F.col("scale"), F.col("row_"))
    return cells.select(
        "scene_id", "scale", "col", "row_", (F.col("col") * F.col("scale")).alias("px_x"), (F.col("row_") * F.col("scale")).alias("px_y"), w.alias("valid_w"), h.alias("valid_h"),
        ((w < F.col("scale")) | (h < F.col("scale"))).alias("is_edge"),
        g.tile_id(F.col("aoi"), F.col("scene_id").cast("string"), F.col("acq_date"), F.col("scale"), F.col("col"), F.col("row_")).alias("tile_id"), *more,
    )


def parsed_ids(ids: DataFrame) -> DataFrame:
    """Parts of tile identifiers and the pixel offsets they stand for (index times scale)."""
    p = F.split("tile_id", "::")
    part = lambda i: F.get(p, F.lit(i))
    scale, col, row = part(3).cast("int"), part(4).cast("int"), part(5).cast("int")
    return ids.select("tile_id", part(0).alias("aoi"), part(1).alias("source"), part(2).alias("acq_date"), scale.alias("scale"), col.alias("col"), row.alias("row_"), (col * scale).alias("px_x"), (row * scale).alias("px_y"))


def frame_tiles(frames: DataFrame, tile: int = 448, overlap: float = 0.2) -> DataFrame:
    """Overlapping half-open tiles of frames (``frame_id, width, height``), row by row."""
    xs, ys = g.starts(F.col("width"), tile, overlap), g.starts(F.col("height"), tile, overlap)
    rows = frames.select("frame_id", "width", "height", F.posexplode(ys).alias("row_", "y0"))
    cells = rows.select("*", F.posexplode(xs).alias("col", "x0"))
    return cells.select(
        "frame_id", "col", "row_", "x0", "y0", F.least(F.col("x0") + tile, F.col("width")).alias("x1"), F.least(F.col("y0") + tile, F.col("height")).alias("y1")
    )


def block_means(pixels: DataFrame, value: str, factor: int) -> DataFrame:
    """Decimated raster: mean of square blocks."""
    return pixels.groupBy("raster_id", F.floor(F.col("x") / factor).cast("int").alias("bx"), F.floor(F.col("y") / factor).cast("int").alias("by")).agg(F.round(F.avg(value), 6).alias("mean"))


def corners(grid: DataFrame, x0: float, y0: float, px: float) -> DataFrame:
    """Longitude and latitude box of each tile from corners computed by integer index, so that neighbours share edges to the bit."""
    lon = lambda c: g.mercator_lon(F.lit(x0) + (c * F.col("scale")) * F.lit(px))
    lat = lambda r: g.mercator_lat(F.lit(y0) - (r * F.col("scale")) * F.lit(px))
    a, b, c, d = lon(F.col("col")), lon(F.col("col") + 1), lat(F.col("row_")), lat(F.col("row_") + 1)
    return grid.select("aoi", "scale", "col", "row_", F.least(a, b).alias("min_lon"), F.least(c, d).alias("min_lat"), F.greatest(a, b).alias("max_lon"), F.greatest(c, d).alias("max_lat"))


def valid_counts(pixels: DataFrame, headers: DataFrame, scales: tuple[int, ...] = SCALES, most: float = 0.5) -> DataFrame:
    """Per raster and scale the three counts that are never the same thing: ``planned`` (padded grid), ``complete`` (whole tiles only) and ``valid``
    (complete tiles of which less than ``most`` is fill: bands 1 to 3 all zero). ``pixels``: raster_id, x, y, b1, b2, b3, one that is absent being fill."""
    sized = headers.select("raster_id", "width", "height", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale"))
    w, h, x = F.col("width"), F.col("height"), F.col("scale")
    sized = sized.withColumn("planned", g.planned(w, x) * g.planned(h, x)).withColumn("cols", g.complete(w, x)).withColumn("rows", g.complete(h, x))
    seen = pixels.filter("b1 <> 0 OR b2 <> 0 OR b3 <> 0").select("raster_id", "x", "y", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale"))
    cell = lambda c: F.floor(F.col(c) / F.col("scale")).cast("int")
    tiles = seen.groupBy("raster_id", "scale", cell("x").alias("col"), cell("y").alias("row_")).agg(F.count(F.lit(1)).alias("n"))
    good = tiles.filter(1 - F.col("n") / (F.col("scale").cast("double") * F.col("scale")) < most).join(sized.select("raster_id", "scale", "cols", "rows"), ["raster_id", "scale"]).filter("col < cols AND row_ < rows")
    valid = good.groupBy("raster_id", "scale").agg(F.count(F.lit(1)).alias("valid"))
    return sized.join(valid, ["raster_id", "scale"], "left").select("raster_id", "scale", "planned", (F.col("cols") * F.col("rows")).alias("complete"), F.coalesce("valid", F.lit(0)).alias("valid"))
