"""Where pixels lie: affine grids of any rotation and pixel shape, true ground resolution on both axes, and a guard that stops a plan whose rule is wrong.

Scenes have ``scene_id, kind`` (mercator, projected, geographic or none), ``zone, south`` (of UTM, else null), ``transform`` (six numbers: x = a col + b row + c,
y = d col + e row + f), ``width, height``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as g

#: Share by which a rule may differ from the ellipsoid.
TOLERANCE = 0.015


def place(transform: Column, col: Column, row: Column) -> tuple[Column, Column]:
    """Projected coordinates of a pixel's upper left corner."""
    a, b, c, d, e, f = (F.get(transform, F.lit(i)) for i in range(6))
    return a * col + b * row + c, d * col + e * row + f


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude by the scene's ``kind``; null where a projected scene has no zone."""
    utm = g.utm_lonlat(x, y, F.col("zone"), F.coalesce("south", F.lit(False)))
    by = lambda m, i, own: F.when(F.col("kind") == "mercator", m).when(F.col("kind") == "geographic", own).when((F.col("kind") == "projected") & F.col("zone").isNotNull(), utm[i])
    return by(g.mercator_lon(x), 0, x), by(g.mercator_lat(y), 1, y)


def tile_boxes(plan: DataFrame, scenes: DataFrame) -> DataFrame:
    """``scene_id, scale, col, row_`` and the box of each planned tile: least and most over its four corners, whatever the transform's signs.

    A corner's place comes from its whole-number index by one expression, so tiles that share an edge share its numbers to the bit, in any task.
    """
    facts = scenes.select("scene_id", "kind", "zone", "south", "transform")
    on = plan.select("scene_id", "scale", "col", "row_").join(facts, "scene_id")
    corners = [lonlat(*place(F.col("transform"), ((F.col("col") + i) * F.col("scale")).cast("double"), ((F.col("row_") + j) * F.col("scale")).cast("double"))) for j in (0, 1) for i in (0, 1)]
    lons, lats = [c[0] for c in corners], [c[1] for c in corners]
    return on.select("scene_id", "scale", "col", "row_", F.least(*lons).alias("min_lon"), F.least(*lats).alias("min_lat"), F.greatest(*lons).alias("max_lon"), F.greatest(*lats).alias("max_lat"))


def ground_resolution(scenes: DataFrame, guard: bool = True) -> DataFrame:
    """``scene_id, kind, px_x, px_y, centre_lon, centre_lat, factor, gsd_x, gsd_y, gsd, geodesic``: metres on the ground, null without a georeference.

    Mercator is corrected by the latitude's cosine, projected systems are taken as they are, and degrees are measured on the ellipsoid. Where a rule and the ellipsoid are apart by
    more than ``TOLERANCE`` the plan raises, naming both, unless ``guard`` is off; nothing is replaced silently.
    """
    known = (F.col("kind") != "none") & g.is_georeferenced(F.col("kind"), F.col("transform"))
    t = F.col("transform")
    px_x, px_y = F.abs(F.get(t, F.lit(0))), F.abs(F.get(t, F.lit(4)))
    x, y = place(t, F.col("width") / 2.0, F.col("height") / 2.0)
    lon, lat = lonlat(x, y)
    rows = scenes.filter(known).withColumns({"px_x": px_x, "px_y": px_y, "_x": x, "_y": y, "centre_lon": lon, "centre_lat": lat})

    def step(dx: Column, dy: Column) -> Column:
        """Metres from the centre to a point one pixel on."""
        far_lon, far_lat = lonlat(F.col("_x") + dx, F.col("_y") + dy)
        across, along = g.geodesic_pixel(F.col("centre_lat"), far_lon - F.col("centre_lon"), far_lat - F.col("centre_lat"))
        return F.sqrt(across * across + along * along)

    measured = rows.withColumns({"_gx": step(F.col("px_x"), F.lit(0.0)), "_gy": step(F.lit(0.0), F.col("px_y"))})
    degrees = F.col("kind") == "geographic"
    factor = g.scale_correction(F.col("kind"), F.col("centre_lat"))
    found = measured.withColumns({"factor": factor, "geodesic": (F.col("_gx") + F.col("_gy")) / 2})
    found = found.withColumns({"gsd_x": F.when(degrees, F.col("_gx")).otherwise(F.col("px_x") * F.col("factor")), "gsd_y": F.when(degrees, F.col("_gy")).otherwise(F.col("px_y") * F.col("factor"))})
    found = found.withColumn("gsd", (F.col("gsd_x") + F.col("gsd_y")) / 2)
    if guard:
        off = ~degrees & (F.abs(F.col("gsd") - F.col("geodesic")) / F.col("geodesic") > TOLERANCE)
        said = F.format_string("scene %s (%s): %.4f cm by rule, %.4f cm on the ellipsoid", F.col("scene_id").cast("string"), "kind", F.col("gsd") * 100, F.col("geodesic") * 100)
        found = found.withColumn("gsd", F.when(off, F.raise_error(said).cast("double")).otherwise(F.col("gsd")))
    columns = ["px_x", "px_y", "centre_lon", "centre_lat", "factor", "gsd_x", "gsd_y", "gsd", "geodesic"]
    return scenes.select("scene_id", "kind").join(found.select(F.col("scene_id").alias("_scene"), *columns), F.col("scene_id").eqNullSafe(F.col("_scene")), "left").drop("_scene")


def with_scene(tiles: DataFrame, scenes: DataFrame, facts: list[str]) -> DataFrame:
    """Tiles with facts of their scene; a tile of an unknown scene raises when the plan runs."""
    joined = tiles.join(scenes.select("scene_id", F.lit(True).alias("_known"), *facts), "scene_id", "left")
    sure = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no scene "), F.col("scene_id").cast("string"))).cast("boolean"))
    return joined.filter(sure).drop("_known")
