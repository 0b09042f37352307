"""Column functions over boxes, tiles and ground coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere of Web Mercator and the WGS84 ellipsoid.
EARTH_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563


def box(x1, y1, x2, y2) -> Column:
    as_double = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.struct(as_double(x1).alias("x1"), as_double(y1).alias("y1"), as_double(x2).alias("x2"), as_double(y2).alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that only touch and for empty ones."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def covered(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` inside ``outer``."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def joined(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def to_frame(b: Column, x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """A box in tile coordinates clipped to its tile and moved into the frame."""
    clip = lambda v, most, at: F.least(F.greatest(v, F.lit(0.0)), most.cast("double")) + at
    return F.struct(clip(b["x1"], w, x0).alias("x1"), clip(b["y1"], h, y0).alias("y1"), clip(b["x2"], w, x0).alias("x2"), clip(b["y2"], h, y0).alias("y2"))


def seams(b: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float) -> Column:
    """Whether a frame box comes within ``margin`` of its tile's left, top, right and bottom edge, where that edge is inside the frame."""
    return F.array((x0 > 0) & (b["x1"] - x0 <= margin), (y0 > 0) & (b["y1"] - y0 <= margin), (x1 < width) & (x1 - b["x2"] <= margin), (y1 < height) & (y1 - b["y2"] <= margin))


def intersects(lon1: Column, lat1: Column, lon2: Column, lat2: Column, q: tuple[float, float, float, float]) -> Column:
    """Closed intervals: touching counts. An inverted query box meets nothing."""
    a, b, c, d = q
    return F.lit(a <= c and b <= d) & (lon1 <= c) & (lon2 >= a) & (lat1 <= d) & (lat2 >= b)


def planned(extent: Column, scale: Column) -> Column:
    """Tiles along an extent, the last one padded."""
    return F.ceil(extent / scale).cast("int")


def complete(extent: Column, scale: Column) -> Column:
    return F.floor(extent / scale).cast("int")


def valid_length(extent: Column, scale: Column, index: Column) -> Column:
    """Pixels of tile ``index`` that lie inside the extent."""
    return F.greatest(F.lit(0), F.least(scale, extent - index * scale))


def tile_id(aoi: Column, source: Column, date: Column, scale: Column, col: Column, row: Column) -> Column:
    """``aoi::source::date::scale::col::row``, indices padded to five digits and longer where they need more."""
    padded = lambda i: F.when(i < 100_000, F.lpad(i.cast("string"), 5, "0")).otherwise(i.cast("string"))
    return F.concat_ws("::", aoi, source, date, scale.cast("string"), padded(col), padded(row))


def starts(extent: Column, tile: int, overlap: float) -> Column:
    """Origins of overlapping tiles along an extent: evenly spread, the last flush with the edge."""
    if tile < 1 or not 0 <= overlap < 1:
        raise ValueError("tile must be positive and overlap in [0, 1)")
    step = max(1, round(tile * (1 - overlap)))
    n = F.greatest(F.lit(1), 1 + F.ceil((extent - tile) / F.lit(float(step)))).cast("int")
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (extent - tile) / (n - 1).cast("double"), 0).cast("int"))
    return F.when(n == 1, F.array(F.lit(0))).otherwise(spread)


def window_starts(extent: Column, window: int, grid: int) -> Column:
    """Distinct origins of ``grid`` sample windows along an extent."""
    free = F.greatest(F.lit(0), extent - window)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.bround(i * free / F.lit(float(grid - 1)), 0).cast("int")))


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(EARTH_RADIUS))


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / F.lit(EARTH_RADIUS))))


def crs_kind(name: Column) -> Column:
    """mercator, projected, geographic or none, from a coordinate system's name; Transverse Mercator is projected."""
    low = F.lower(name)
    return (
        F.when(name.isNull() | (low == ""), "none")
        .when(low.contains("mercator") & ~low.contains("transverse"), "mercator")
        .when(low.contains("geographic") | low.contains("latlon"), "geographic")
        .otherwise("projected")
    )


def scale_correction(kind: Column, lat: Column) -> Column:
    return F.when(kind == "mercator", F.cos(F.radians(lat))).when(kind == "projected", F.lit(1.0))


def geodesic_pixel(lat: Column, step_lon: Column, step_lat: Column) -> tuple[Column, Column]:
    """Metres of a small step in degrees at a latitude, from the ellipsoid's two radii; exact in the limit of small steps."""
    e2 = FLATTENING * (2 - FLATTENING)
    s = F.sin(F.radians(lat))
    w = F.sqrt(1 - e2 * s * s)
    across = F.lit(EARTH_RADIUS) / w * F.cos(F.radians(lat)) * F.lit(math.pi / 180) * step_lon
    along = F.lit(EARTH_RADIUS * (1 - e2)) / (w * w * w) * F.lit(math.pi / 180) * step_lat
    return across, along


def read_amplification(offset: Column, window: int, block_w: Column, block_h: Column, width: Column, height: Column) -> Column:
    """Pixels of the blocks that a square window touches, over the pixels of the window inside the raster."""
    across = F.floor((F.least(offset + window, width) - 1) / block_w) - F.floor(offset / block_w) + 1
    down = F.floor((F.least(offset + window, height) - 1) / block_h) - F.floor(offset / block_h) + 1
    useful = F.least(F.lit(window), width - offset) * F.least(F.lit(window), height - offset)
    return across * down * block_w * block_h / useful.cast("double")


def is_georeferenced(crs: Column, transform: Column) -> Column:
    """A coordinate system and a transform (six numbers) that is not the identity, which stands for none."""
    identity = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])
    return F.coalesce(crs.isNotNull() & transform.isNotNull() & (transform.cast("array<double>") != identity), F.lit(False))


def utm_lonlat(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of transverse Mercator coordinates in a UTM zone of WGS 84, by the series in the third flattening to its third power (below a millimetre)."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    radius = EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (northing - F.when(south, 10_000_000.0).otherwise(0.0)) / (0.9996 * radius)
    eta = (easting - 500_000.0) / (0.9996 * radius)
    xi_ = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    eta_ = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))) + zone * 6 - 183, F.degrees(lat)
