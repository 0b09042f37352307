"""Queries that plan tiles and take stock of rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import geometry as g
from tilespark.functions import text as t
from tilespark.operators import grids, inventory, packing, tiling
from tilespark.session import written
from tilespark.sources.views import oracle, table


def _scenes(spark, sf_dir):
    s = table(spark, sf_dir, "scenes")
    return s.withColumn("aoi", t.scene_aoi(F.col("path"))).withColumn("acq_date", t.scene_date(F.col("path")))


def tile_plan(spark, sf_dir):
    return tiling.tile_plan(_scenes(spark, sf_dir))


def tile_counts(spark, sf_dir):
    """Planned and complete tiles per scale; three counts that are never the same thing."""
    s = table(spark, sf_dir, "scenes").withColumn("scale", F.explode(F.array(*[F.lit(x) for x in tiling.SCALES])))
    w, h, x = F.col("width"), F.col("height"), F.col("scale")
    return s.groupBy("scale").agg(F.sum(g.planned(w, x) * g.planned(h, x)).alias("planned"), F.sum(g.complete(w, x) * g.complete(h, x)).alias("complete"))


def tile_id_roundtrip(spark, sf_dir):
    grid = table(spark, sf_dir, "tile_grid")
    ids = grid.select(g.tile_id(F.col("aoi"), F.concat(F.lit("s"), F.col("vec_id").cast("string")), F.col("acq_date"), F.col("scale"), F.col("col"), F.col("row_")).alias("tile_id"))
    return tiling.parsed_ids(ids)


def valid_tiles(spark, sf_dir):
    return table(spark, sf_dir, "tile_grid").groupBy("aoi", "scale").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(F.col("nodata_fraction") < 0.5).alias("valid"), F.count_if(F.col("nodata_fraction") < 1.0).alias("embedded"), F.round(F.avg("nodata_fraction"), 6).alias("nodata")
    )


def overlap_tile_origins(spark, sf_dir):
    return tiling.frame_tiles(table(spark, sf_dir, "scenes").withColumnRenamed("scene_id", "frame_id"))


def sample_windows(spark, sf_dir):
    s = table(spark, sf_dir, "scenes")
    rows = s.select("scene_id", "width", F.explode(g.window_starts(F.col("height"), 64, 8)).alias("y"))
    return rows.select("scene_id", F.explode(g.window_starts(F.col("width"), 64, 8)).alias("x"), "y")


def check_offsets(spark, sf_dir):
    """A five by five grid of windows on which a re-encoded copy is compared."""
    s = table(spark, sf_dir, "scenes")
    rows = s.select("scene_id", "width", F.explode(g.window_starts(F.col("height"), 256, 5)).alias("y"))
    return rows.select("scene_id", F.explode(g.window_starts(F.col("width"), 256, 5)).alias("x"), "y")


def read_amplification(spark, sf_dir):
    """A square window read from rasters stored in strips and in blocks."""
    s = table(spark, sf_dir, "scenes")
    w, h = F.col("width"), F.col("height")
    strips, blocks = g.read_amplification(F.lit(100), 300, w, F.lit(1), w, h), g.read_amplification(F.lit(100), 300, F.lit(256), F.lit(256), w, h)
    return s.select("scene_id", F.round(strips, 6).alias("strips"), F.round(blocks, 6).alias("blocks"))


def tile_bbox_mercator(spark, sf_dir):
    b = tiling.corners(table(spark, sf_dir, "tile_grid"), 3785000.0, 3630000.0, 0.125)
    return b.select("aoi", "scale", "col", "row_", *[F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


def shared_edges(spark, sf_dir):
    """Neighbours along a row whose common edge is the same number: all of them."""
    b = tiling.corners(table(spark, sf_dir, "tile_grid"), 3785000.0, 3630000.0, 0.125)
    right = b.select("aoi", "scale", (F.col("col") - 1).alias("col"), "row_", F.col("min_lon").alias("next_lon"))
    return b.join(right, ["aoi", "scale", "col", "row_"]).groupBy("scale").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("max_lon") == F.col("next_lon")).alias("equal"))


def basemap_blocks(spark, sf_dir):
    return tiling.block_means(table(spark, sf_dir, "pixels"), "b1", 8)


def nodata_by_tile(spark, sf_dir):
    """Share of fill (all three bands zero, or nothing) of each 16-pixel tile, over the whole tile."""
    p = table(spark, sf_dir, "pixels")
    return p.groupBy("raster_id", F.floor(F.col("x") / 16).cast("int").alias("col"), F.floor(F.col("y") / 16).cast("int").alias("row_")).agg(F.round(1.0 - F.count_if(F.expr("b1 <> 0 OR b2 <> 0 OR b3 <> 0")) / F.lit(256.0), 6).alias("nodata"))


def scene_valid_counts(spark, sf_dir):
    """Planned, complete and valid tiles of every raster, of 16, 8 and 4 pixels; rasters end inside their last tiles."""
    p = table(spark, sf_dir, "pixels")
    headers = p.select("raster_id").distinct().select("raster_id", (64 - F.col("raster_id") % 7).alias("width"), (64 - F.col("raster_id") % 5).alias("height"))
    return tiling.valid_counts(p, headers, (16, 8, 4))


def first_tiles(spark, sf_dir):
    """The first thousand tiles in the order in which they are embedded."""
    return tiling.tile_plan(_scenes(spark, sf_dir), limit=1000).select("scene_id", "scale", "row_", "col")


def georeferenced(spark, sf_dir):
    """Scenes with a coordinate system and a transform; those of the UTM zone with the place of their corner."""
    s = table(spark, sf_dir, "scenes")
    transform = F.when(F.col("scene_id") % 5 == 0, F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])).otherwise(F.array(F.col("px"), F.lit(0.0), F.lit(650000.0), F.lit(0.0), -F.col("px"), F.lit(3500000.0)))
    lon, lat = g.utm_lonlat(F.lit(650000.0) + F.col("width"), F.lit(3500000.0) - F.col("height"), F.lit(36), F.lit(False))
    here = F.col("crs").contains("UTM")
    return s.select("scene_id", g.is_georeferenced(F.col("crs"), transform).alias("georeferenced"), F.when(here, F.round(lon, 9)).alias("lon"), F.when(here, F.round(lat, 9)).alias("lat"))


def pixel_rule(spark, sf_dir):
    b = table(spark, sf_dir, "raster_bands").withColumn("levels", F.when(F.col("band_count") == 3, F.array("d1", "d2", "d3")).otherwise(F.array("d1")))
    return b.select("raster_id", inventory.is_imagery(F.col("band_count"), F.col("levels")).alias("is_source"), inventory.pixel_reason(F.col("band_count"), F.col("levels")).alias("reason"))


def band_distinct_levels(spark, sf_dir):
    """Exact distinct values of every band of every raster."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("raster_id"), F.explode(F.array(F.struct(F.lit(1).alias("band"), (F.col("l_partkey") % 101).alias("v")), F.struct(F.lit(2).alias("band"), (F.floor("l_extendedprice") % 90).alias("v")),
            F.struct(F.lit(3).alias("band"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_orderkey") % 6).otherwise(F.col("l_orderkey") % 97).alias("v")))).alias("p")
    )
    return rows.groupBy("raster_id", F.col("p.band").alias("band")).agg(F.countDistinct("p.v").alias("levels"))


def inventory_counts(spark, sf_dir):
    b = table(spark, sf_dir, "raster_bands").withColumn("levels", F.when(F.col("band_count") == 3, F.array("d1", "d2", "d3")).otherwise(F.array("d1")))
    reason = F.coalesce(inventory.pixel_reason(F.col("band_count"), F.col("levels")), F.lit("source"))
    return b.select(reason.alias("reason"), "d1", F.array_min("levels").alias("least")).groupBy("reason").agg(F.count(F.lit(1)).alias("rasters"), F.min("least").alias("least"), F.max("d1").alias("most"))


def gsd_by_crs(spark, sf_dir):
    """Ground resolution by coordinate system, the tile's extent, and why a scene is not indexed."""
    s = table(spark, sf_dir, "scenes").withColumn("kind", g.crs_kind(F.col("crs")))
    gsd = F.col("px") * g.scale_correction(F.col("kind"), F.col("lat"))
    s = s.withColumn("gsd", F.round(gsd, 9))
    reason = inventory.index_reason(F.lit(None).cast("string"), F.col("kind") != "none", F.lit(False), F.col("gsd"))
    return s.select("scene_id", "kind", "gsd", F.round(F.col("gsd") * 448, 6).alias("extent_m"), reason.alias("reason"))


def geodesic_check(spark, sf_dir):
    """The Mercator rule against ellipsoidal radii: the deviation a guard would report."""
    s = table(spark, sf_dir, "scenes").filter("crs LIKE '%Pseudo%'")
    step = F.degrees(F.col("px") / F.lit(g.EARTH_RADIUS))
    across, along = g.geodesic_pixel(F.col("lat"), step, step * F.cos(F.radians("lat")))
    rule = F.col("px") * F.cos(F.radians("lat"))
    return s.select("scene_id", F.round(across, 9).alias("across_m"), F.round(along, 9).alias("along_m"), (F.abs((across + along) / 2 - rule) / rule > 0.015).alias("raises"))


def _located(spark, sf_dir):
    """Scenes in two systems, turned and with pixels that are not square."""
    s = table(spark, sf_dir, "scenes").filter("scene_id % 3 <> 2")
    geographic = F.col("scene_id") % 3 == 1
    px = F.when(geographic, F.col("px") / 100_000).otherwise(F.col("px"))
    turn = F.col("scene_id") % 5 / 50.0
    corner = lambda deg, metres: F.when(geographic, F.lit(deg) + F.col("lat") / 10).otherwise(F.lit(metres) + F.col("lat") * 1000)
    transform = F.array(px, px * turn, corner(30.0, 3_785_000.0), px * turn, -px * 1.25, corner(25.0, 3_630_000.0))
    return s.select("scene_id", F.when(geographic, "geographic").otherwise("mercator").alias("kind"), F.lit(None).cast("int").alias("zone"), F.lit(None).cast("boolean").alias("south"), F.when(F.col("scene_id") % 7 != 0, transform).alias("transform"), "width", "height")


def ground_resolution(spark, sf_dir):
    """Metres on the ground on both axes, by rule and on the ellipsoid; the plan raises where they are apart."""
    found = grids.ground_resolution(_located(spark, sf_dir))
    return found.select("scene_id", "kind", *[F.round(c, 7).alias(c) for c in ("centre_lon", "centre_lat", "gsd_x", "gsd_y", "gsd", "geodesic")])


def affine_boxes(spark, sf_dir):
    """Boxes of the planned tiles of 448 pixels on turned grids, and how many edges they share with the next tile to the right."""
    s = _located(spark, sf_dir).filter("transform IS NOT NULL")
    plan = s.select("scene_id", F.lit(448).alias("scale"), F.explode(F.sequence(F.lit(0), g.planned(F.col("height"), F.lit(448)) - 1)).alias("row_"), "width").withColumn("col", F.explode(F.sequence(F.lit(0), g.planned(F.col("width"), F.lit(448)) - 1)))
    boxes = grids.tile_boxes(plan, s)
    return boxes.select("scene_id", "col", "row_", *[F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


def content_duplicates(spark, sf_dir):
    """Documents whose content an earlier one has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return inventory.copies(d, "doc_id", ["digest"], [F.col("doc_id")])


def tree_digest(spark, sf_dir):
    return inventory.tree_digest(table(spark, sf_dir, "documents"), "doc_id", ["n_chars", "lang"])


def contained_rasters(spark, sf_dir):
    return inventory.contained(_rasters(spark, sf_dir))


def _rasters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("raster_id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("grid"), (F.col("p_partkey") % 7 * 64).alias("x0"), (F.col("p_partkey") % 5 * 64).alias("y0"),
        (F.col("p_partkey") % 11 * 64 + 128).alias("width"), (F.col("p_partkey") % 13 * 64 + 128).alias("height"),
    )


def equal_pixels(spark, sf_dir):
    """Rasters next to each other in number, compared pixel by pixel at an offset of none."""
    p = table(spark, sf_dir, "pixels")
    ids = p.select("raster_id").distinct()
    pairs = ids.select(F.col("raster_id").alias("in_raster_id"), (F.col("raster_id") + 1).alias("out_raster_id"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    return inventory.same_pixels(pairs, p)


def raster_duplicates(spark, sf_dir):
    """Every raster with the original that it copies or is cropped from, verified pixel by pixel, and why it is not indexed."""
    s = table(spark, sf_dir, "scenes").withColumn("kind", g.crs_kind(F.col("crs")))
    s = s.select(F.col("scene_id").alias("raster_id"), "kind", F.round(F.col("px") * g.scale_correction(F.col("kind"), F.col("lat")), 9).alias("gsd"))
    r = _rasters(spark, sf_dir).join(s, "raster_id").join(pixel_rule(spark, sf_dir).select("raster_id", F.col("reason").alias("pixel")), "raster_id", "left")
    r = written(r, "rasters")  # the levels of all bands are counted once
    found = inventory.duplicates(r.filter("pixel IS NULL AND kind <> 'none'"), table(spark, sf_dir, "pixels"))
    reason = inventory.index_reason(F.col("pixel"), F.col("kind") != "none", F.col("duplicate_of").isNotNull(), F.col("gsd"))
    return r.join(found, "raster_id", "left").select("raster_id", "duplicate_of", reason.alias("reason"))


#: The bytes of one row of the picture that crops are cut from, 251 pixels and the widest crop long: every row is this row, begun elsewhere (36 is the inverse of 7 modulo 251).
_ROW = bytes((7 * x + 5 * b) % 251 for x in range(251 + 48) for b in range(3))


def _crops(spark, sf_dir, more=None):
    """Rasters cut from one picture for each brand, as strips of three bands; every fifth has one pixel of band 2 changed.

    ``more`` gives, from the rasters, those whose strips are cut, with their number in the picture as ``of``; else each is cut once. The few numbers of a raster are dealt
    by its id and its strips are cut where it lies, so that strips meet others of their raster in place.
    """
    p = table(spark, sf_dir, "part")
    r = p.select(
        F.col("p_partkey").alias("raster_id"), F.col("p_brand").alias("grid"), (F.col("p_partkey") % 7 * 4).alias("x0"), (F.col("p_partkey") % 5 * 4).alias("y0"), (F.col("p_partkey") % 11 * 4 + 8).alias("width"),
        (F.col("p_partkey") % 13 * 4 + 8).alias("height"),
    )
    dealt = (more(r) if more else r.withColumn("of", F.col("raster_id"))).select("raster_id", "of", "x0", "y0", "width", "height").repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "raster_id")
    rows = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)))
    byte = lambda n: n.cast("int")
    plain = F.substring(F.lit(_ROW), byte((F.col("x0") + (F.col("y0") + F.col("y")) * (13 * 36)) % 251 * 3 + 1), byte(F.col("width") * 3))
    k = F.col("of") % 7 * 3 + 1
    other = F.substring(F.lit(bytes(range(251))), byte(((F.col("x0") + F.col("of") % 7) * 7 + (F.col("y0") + F.col("y")) * 13 + 5 + 1) % 251 + 1), F.lit(1))
    changed = F.concat(F.substring(plain, F.lit(1), byte(k)), other, F.substring(plain, byte(k + 2), byte(F.col("width") * 3)))
    data = F.when((F.col("of") % 5 == 0) & (F.col("y") == F.col("of") % 8), changed).otherwise(plain)
    return r, rows.select("raster_id", "y", F.lit(3).alias("pixel_bytes"), data.alias("data"))


def crop_duplicates(spark, sf_dir):
    """Rasters that are copies or crops of larger ones, by strips over all bands: one that differs in a single pixel of band 2 is none."""
    r, strips = _crops(spark, sf_dir)
    return inventory.duplicate_strips(r, strips)


def tile_windows(spark, sf_dir):
    """Digests of every tile's pixels, cut from strips and padded over the right and lower edge."""
    r, strips = _crops(spark, sf_dir)
    steps = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1, F.lit(16).cast("long"))
    tiles = r.select("raster_id", F.lit(16).alias("scale"), F.explode(steps("width")).alias("px_x"), "height").select("raster_id", "scale", "px_x", F.explode(steps("height")).alias("px_y"))
    tiles = tiles.withColumn("tile_id", F.concat_ws("_", "raster_id", "px_x", "px_y"))
    return packing.tile_bytes(strips, tiles).select("tile_id", F.length("data").cast("long").alias("bytes"), F.md5("data").alias("digest"))


def copy_check(spark, sf_dir):
    """Copies of rasters, of which some have another header and some a changed pixel, in or beside the windows that are compared."""
    with_copies = lambda r: r.select("*", F.explode(F.array(F.col("raster_id"), -1 - F.col("raster_id"))).alias("_id")).withColumnsRenamed({"raster_id": "of", "_id": "raster_id"})
    r, strips = _crops(spark, sf_dir, with_copies)
    own = -1 - F.col("raster_id")  # a copy's source
    width, height = own % 11 * 4 + 8, own % 13 * 4 + 8
    byte = own % width * 3 + 2  # the last band of a pixel
    flipped = F.concat(F.substring(F.col("data"), F.lit(1), byte.cast("int")), F.unhex(F.lit("FF")), F.substring(F.col("data"), (byte + 2).cast("int"), F.length("data")))
    strips = strips.withColumn("data", F.when((F.col("raster_id") < 0) & (own % 9 == 4) & (F.col("y") == own % height), flipped).otherwise(F.col("data")))
    odd = F.col("raster_id") % 9
    headers = r.select("raster_id", "width", "height", "grid").unionByName(r.select((-1 - F.col("raster_id")).alias("raster_id"), "width", "height", F.when(odd == 5, F.lit(None)).otherwise(F.col("grid")).alias("grid")))
    pairs = r.select(F.col("raster_id").alias("source_id"), (-1 - F.col("raster_id")).alias("copy_id"))
    return inventory.copy_check(pairs, headers, strips, window=4, grid=3)


def path_keys(spark, sf_dir):
    """Path keys, areas and dates from paths with either separator."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(".\\area"), (F.col("p_partkey") % 5).cast("string"), F.lit("//"), F.col("p_brand"), F.lit("\\2024-01-0"), (1 + F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_size") % 2 == 0, ".TIF").otherwise(".jp2")).alias("path"))
    k = t.posix_key(F.col("path"))
    return p.select("p_partkey", k.alias("key"), t.scene_aoi(k).alias("aoi"), t.scene_date(k).alias("acq_date"))


QUERIES = {
    f.__name__: f
    for f in (scene_valid_counts, first_tiles, georeferenced, tile_plan, tile_counts, tile_id_roundtrip, valid_tiles, overlap_tile_origins, sample_windows, check_offsets, read_amplification, tile_bbox_mercator, shared_edges, basemap_blocks, nodata_by_tile, pixel_rule, band_distinct_levels, inventory_counts, gsd_by_crs, geodesic_check, ground_resolution, affine_boxes, content_duplicates, tree_digest, contained_rasters, equal_pixels, raster_duplicates, crop_duplicates, tile_windows, copy_check, path_keys)
}

_SCALED = "scaled AS (SELECT *, unnest([448, 224, 112]) AS scale FROM {scenes})"
_STARTS = "CASE WHEN {e} <= 448 THEN [0] ELSE list_transform(range(0, 1 + CAST(ceil(({e} - 448) / CAST(358 AS DOUBLE)) AS INT)), lambda i: CAST(round_even(i * ({e} - 448) / CAST(ceil(({e} - 448) / CAST(358 AS DOUBLE)) AS DOUBLE), 0) AS INT)) END"
_WINDOWS = "list_distinct(list_transform(range(0, {n}), lambda i: CAST(round_even(i * greatest(0, {e} - {w}) / CAST({n} - 1 AS DOUBLE), 0) AS INT)))"
_LEVELS = "levels AS (SELECT *, band_count = 3 AND d1 > 64 AND d2 > 64 AND d3 > 64 AS is_source, CASE WHEN band_count < 3 THEN 'too_few_bands' WHEN NOT (d1 > 64 AND d2 > 64 AND d3 > 64) THEN 'derived_raster' END AS reason FROM {raster_bands})"
_LON, _LAT = "degrees((3785000e0 + ({c}) * scale * 0.125e0) / 6378137e0)", "degrees(atan(sinh((3630000e0 - ({r}) * scale * 0.125e0) / 6378137e0)))"
_EDGE = f"edge AS (SELECT aoi, scale, col, row_, {_LON.format(c='col')} AS min_lon, {_LAT.format(r='row_ + 1')} AS min_lat, {_LON.format(c='col + 1')} AS max_lon, {_LAT.format(r='row_')} AS max_lat FROM {{tile_grid}})"
_KIND = "CASE WHEN crs IS NULL THEN 'none' WHEN lower(crs) LIKE '%mercator%' AND lower(crs) NOT LIKE '%transverse%' THEN 'mercator' ELSE 'projected' END"


def _plain(text: str, **parts) -> str:
    for k, v in parts.items():
        text = text.replace("{" + k + "}", str(v))
    return text


def _amplified(bw: str, bh: str) -> str:
    touched = lambda n, b: f"(floor((least(400, {n}) - 1) / CAST({b} AS DOUBLE)) - floor(100 / CAST({b} AS DOUBLE)) + 1)"
    return f"round({touched('width', bw)} * {touched('height', bh)} * {bw} * {bh} / CAST(least(300, width - 100) * least(300, height - 100) AS DOUBLE), 6)"


def _utm_sql() -> str:
    """The same series, written out."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    terms = lambda c, f, h: " ".join(f"- {b!r}e0 * {f}({2 * j + 2} * xi) * {h}({2 * j + 2} * eta)" if "e-" not in repr(b) else f"- CAST('{b!r}' AS DOUBLE) * {f}({2 * j + 2} * xi) * {h}({2 * j + 2} * eta)" for j, b in enumerate(c))
    lat = " ".join(f"+ CAST('{d!r}' AS DOUBLE) * sin({2 * j + 2} * chi)" for j, d in enumerate(delta))
    return f"""WITH e AS (SELECT *, (3500000e0 - height) / {radius!r}e0 AS xi, (150000e0 + width) / {radius!r}e0 AS eta FROM {{scenes}}),
          f AS (SELECT *, xi {terms(beta, 'sin', 'cosh')} AS xi2, eta {terms(beta, 'cos', 'sinh')} AS eta2 FROM e), c AS (SELECT *, asin(sin(xi2) / cosh(eta2)) AS chi FROM f)
          SELECT scene_id, crs IS NOT NULL AND scene_id % 5 <> 0 AS georeferenced, CASE WHEN crs LIKE '%UTM%' THEN round(degrees(atan2(sinh(eta2), cos(xi2))) + 33, 9) END AS lon,
            CASE WHEN crs LIKE '%UTM%' THEN round(degrees(chi {lat}), 9) END AS lat FROM c"""


_LOCATED = """s AS (SELECT scene_id, scene_id % 3 = 1 AS deg, lat, width, height, CASE WHEN scene_id % 3 = 1 THEN px / 100000 ELSE px END AS p, scene_id % 5 / 50e0 AS turn FROM {scenes} WHERE scene_id % 3 <> 2),
a AS (SELECT *, CASE WHEN deg THEN 30 + lat / 10 ELSE 3785000 + lat * 1000 END AS x0, CASE WHEN deg THEN 25 + lat / 10 ELSE 3630000 + lat * 1000 END AS y0 FROM s)"""
_LON, _LAT = "CASE WHEN deg THEN {0} ELSE degrees({0} / 6378137) END", "CASE WHEN deg THEN {0} ELSE degrees(atan(sinh({0} / 6378137))) END"
_E2 = "(1 / 298.257223563e0 * (2 - 1 / 298.257223563e0))"
_METRES = f"sqrt(pow(6378137 / sqrt(1 - {_E2} * pow(sin(radians(clat)), 2)) * cos(radians(clat)) * radians({{0}}), 2) + pow(6378137 * (1 - {_E2}) / pow(1 - {_E2} * pow(sin(radians(clat)), 2), 1.5e0) * radians({{1}}), 2))"

ORACLE = {
    name: oracle(sql)
    for name, sql in {
        "tile_plan": f"""WITH {_SCALED}, r AS (SELECT *, unnest(range(0, CAST(ceil(height / CAST(scale AS DOUBLE)) AS INT))) AS r FROM scaled),
          c AS (SELECT *, unnest(range(0, CAST(ceil(width / CAST(scale AS DOUBLE)) AS INT))) AS c FROM r),
          v AS (SELECT scene_id, scale, CAST(c AS INT) AS col, CAST(r AS INT) AS row_, greatest(0, least(scale, width - c * scale)) AS w, greatest(0, least(scale, height - r * scale)) AS h,
            string_split(path, '/')[1] AS aoi, regexp_extract(path, '(\\d\\d\\d\\d-\\d\\d-\\d\\d)[.]tif$', 1) AS d FROM c)
          SELECT scene_id, scale, col, row_, col * scale AS px_x, row_ * scale AS px_y, CAST(w AS INT) AS valid_w, CAST(h AS INT) AS valid_h, w < scale OR h < scale AS is_edge,
            concat_ws('::', aoi, CAST(scene_id AS VARCHAR), d, CAST(scale AS VARCHAR), printf('%05d', col), printf('%05d', row_)) AS tile_id FROM v""",
        "scene_valid_counts": """WITH h AS (SELECT DISTINCT raster_id, CAST(64 - raster_id % 7 AS INT) AS w, CAST(64 - raster_id % 5 AS INT) AS h FROM {pixels}), z AS (SELECT *, unnest([16, 8, 4]) AS scale FROM h),
          t AS (SELECT p.raster_id, z.scale, x // z.scale AS c, y // z.scale AS r, count(*) AS n FROM {pixels} p JOIN z ON p.raster_id = z.raster_id WHERE (b1 <> 0 OR b2 <> 0 OR b3 <> 0) AND x // z.scale < w // z.scale AND y // z.scale < h // z.scale GROUP BY ALL),
          v AS (SELECT raster_id, scale, count(*) AS valid FROM t WHERE 1 - n / CAST(scale * scale AS DOUBLE) < 0.5 GROUP BY 1, 2)
          SELECT z.raster_id, z.scale, CAST(ceil(w / CAST(z.scale AS DOUBLE)) * ceil(h / CAST(z.scale AS DOUBLE)) AS INT) AS planned, CAST((w // z.scale) * (h // z.scale) AS INT) AS complete, coalesce(valid, 0) AS valid FROM z LEFT JOIN v ON v.raster_id = z.raster_id AND v.scale = z.scale""",
        "first_tiles": f"""WITH {_SCALED}, r AS (SELECT *, unnest(range(0, CAST(ceil(height / CAST(scale AS DOUBLE)) AS INT))) AS r FROM scaled), c AS (SELECT *, unnest(range(0, CAST(ceil(width / CAST(scale AS DOUBLE)) AS INT))) AS c FROM r)
          SELECT scene_id, scale, CAST(r AS INT) AS row_, CAST(c AS INT) AS col FROM c ORDER BY string_split(path, '/')[1], scale DESC, scene_id, r, c LIMIT 1000""",
        "georeferenced": _utm_sql(),
        "tile_counts": f"""WITH {_SCALED} SELECT scale, CAST(sum(ceil(width / CAST(scale AS DOUBLE)) * ceil(height / CAST(scale AS DOUBLE))) AS BIGINT) AS planned,
          CAST(sum(floor(width / CAST(scale AS DOUBLE)) * floor(height / CAST(scale AS DOUBLE))) AS BIGINT) AS complete FROM scaled GROUP BY scale""",
        "tile_id_roundtrip": """SELECT concat_ws('::', aoi, 's' || vec_id, acq_date, CAST(scale AS VARCHAR), printf('%05d', col), printf('%05d', row_)) AS tile_id, aoi, 's' || vec_id AS source, acq_date, scale, col, row_,
          col * scale AS px_x, row_ * scale AS px_y FROM {tile_grid}""",
        "valid_tiles": "SELECT aoi, scale, count(*) AS planned, count(*) FILTER (nodata_fraction < 0.5) AS valid, count(*) FILTER (nodata_fraction < 1) AS embedded, round(avg(nodata_fraction), 6) AS nodata FROM {tile_grid} GROUP BY aoi, scale",
        "overlap_tile_origins": f"""WITH s AS (SELECT scene_id AS frame_id, width, height, {_plain(_STARTS, e='width')} AS xs, {_plain(_STARTS, e='height')} AS ys FROM {{scenes}}),
          y AS (SELECT *, unnest(range(0, len(ys))) AS row_ FROM s), x AS (SELECT *, unnest(range(0, len(xs))) AS col FROM y)
          SELECT frame_id, CAST(col AS INT) AS col, CAST(row_ AS INT) AS row_, xs[col + 1] AS x0, ys[row_ + 1] AS y0, least(xs[col + 1] + 448, width) AS x1, least(ys[row_ + 1] + 448, height) AS y1 FROM x""",
        "sample_windows": f"WITH y AS (SELECT scene_id, width, unnest({_plain(_WINDOWS, n=8, e='height', w=64)}) AS y FROM {{scenes}}) SELECT scene_id, unnest({_plain(_WINDOWS, n=8, e='width', w=64)}) AS x, y FROM y",
        "check_offsets": f"WITH y AS (SELECT scene_id, width, unnest({_plain(_WINDOWS, n=5, e='height', w=256)}) AS y FROM {{scenes}}) SELECT scene_id, unnest({_plain(_WINDOWS, n=5, e='width', w=256)}) AS x, y FROM y",
        "read_amplification": f"SELECT scene_id, {_amplified('width', '1')} AS strips, {_amplified('256', '256')} AS blocks FROM {{scenes}}",
        "tile_bbox_mercator": f"WITH {_EDGE} SELECT aoi, scale, col, row_, round(min_lon, 9) AS min_lon, round(min_lat, 9) AS min_lat, round(max_lon, 9) AS max_lon, round(max_lat, 9) AS max_lat FROM edge",
        "shared_edges": f"WITH {_EDGE} SELECT a.scale, count(*) AS pairs, count(*) FILTER (a.max_lon = b.min_lon) AS equal FROM edge a JOIN edge b ON a.aoi = b.aoi AND a.scale = b.scale AND a.row_ = b.row_ AND a.col = b.col - 1 GROUP BY a.scale",
        "basemap_blocks": "SELECT raster_id, CAST(floor(x / CAST(8 AS DOUBLE)) AS INT) AS bx, CAST(floor(y / CAST(8 AS DOUBLE)) AS INT) AS by, round(avg(b1), 6) AS mean FROM {pixels} GROUP BY 1, 2, 3",
        "nodata_by_tile": "SELECT raster_id, CAST(floor(x / CAST(16 AS DOUBLE)) AS INT) AS col, CAST(floor(y / CAST(16 AS DOUBLE)) AS INT) AS row_, round(1 - count(*) FILTER (b1 <> 0 OR b2 <> 0 OR b3 <> 0) / CAST(256 AS DOUBLE), 6) AS nodata FROM {pixels} GROUP BY 1, 2, 3",
        "pixel_rule": f"WITH {_LEVELS} SELECT raster_id, is_source, reason FROM levels",
        "band_distinct_levels": """SELECT l_suppkey AS raster_id, 1 AS band, count(DISTINCT l_partkey % 101) AS levels FROM {lineitem} GROUP BY 1
          UNION ALL SELECT l_suppkey, 2, count(DISTINCT CAST(floor(l_extendedprice) AS BIGINT) % 90) FROM {lineitem} GROUP BY 1
          UNION ALL SELECT l_suppkey, 3, count(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey % 6 ELSE l_orderkey % 97 END) FROM {lineitem} GROUP BY 1""",
        "inventory_counts": f"WITH {_LEVELS} SELECT coalesce(reason, 'source') AS reason, count(*) AS rasters, min(CASE WHEN band_count = 3 THEN least(d1, d2, d3) ELSE d1 END) AS least, max(d1) AS most FROM levels GROUP BY 1",
        "gsd_by_crs": f"""WITH k AS (SELECT *, {_KIND} AS kind FROM {{scenes}}),
          s AS (SELECT *, round(CASE kind WHEN 'mercator' THEN px * cos(radians(lat)) WHEN 'projected' THEN px END, 9) AS gsd FROM k)
          SELECT scene_id, kind, gsd, round(gsd * 448, 6) AS extent_m, CASE WHEN kind = 'none' THEN 'not_georeferenced' WHEN gsd IS NULL OR NOT gsd BETWEEN 0.05 AND 0.15 THEN 'gsd_out_of_range' END AS reason FROM s""",
        "geodesic_check": """WITH w AS (SELECT *, sqrt(1 - 0.0066943799901413165e0 * sin(radians(lat)) * sin(radians(lat))) AS w, degrees(px / 6378137e0) AS step FROM {scenes} WHERE crs LIKE '%Pseudo%'),
          m AS (SELECT *, 6378137e0 / w * cos(radians(lat)) * (pi() / 180) * step AS across, 6378137e0 * (1 - 0.0066943799901413165e0) / (w * w * w) * (pi() / 180) * step * cos(radians(lat)) AS along, px * cos(radians(lat)) AS rule FROM w)
          SELECT scene_id, round(across, 9) AS across_m, round(along, 9) AS along_m, abs((across + along) / 2 - rule) / rule > 0.015 AS raises FROM m""",
        "content_duplicates": "SELECT doc_id, canonical_id AS duplicate_of FROM {docs_content} WHERE canonical_id <> doc_id",
        "ground_resolution": f"""WITH {_LOCATED}, c AS (SELECT *, p * (width / 2e0) + p * turn * (height / 2e0) + x0 AS x, p * turn * (width / 2e0) - p * 1.25e0 * (height / 2e0) + y0 AS y FROM a WHERE scene_id % 7 <> 0),
          d AS (SELECT *, {_LON.format("x")} AS clon, {_LAT.format("y")} AS clat FROM c),
          m AS (SELECT *, {_METRES.format("(" + _LON.format("(x + p)") + " - clon)", "0")} AS gx, {_METRES.format("0", "(" + _LAT.format("(y + p * 1.25e0)") + " - clat)")} AS gy FROM d),
          r AS (SELECT *, CASE WHEN deg THEN gx ELSE p * cos(radians(clat)) END AS gsd_x, CASE WHEN deg THEN gy ELSE p * 1.25e0 * cos(radians(clat)) END AS gsd_y FROM m)
          SELECT a.scene_id, CASE WHEN a.deg THEN 'geographic' ELSE 'mercator' END AS kind, round(clon, 7) AS centre_lon, round(clat, 7) AS centre_lat, round(gsd_x, 7) AS gsd_x, round(gsd_y, 7) AS gsd_y, round((gsd_x + gsd_y) / 2, 7) AS gsd, round((gx + gy) / 2, 7) AS geodesic
          FROM a LEFT JOIN r USING (scene_id)""",
        "affine_boxes": f"""WITH {_LOCATED}, t AS (SELECT *, CAST(unnest(range(CAST(ceil(width / 448e0) AS INT))) AS INT) AS col FROM a WHERE scene_id % 7 <> 0), u AS (SELECT *, CAST(unnest(range(CAST(ceil(height / 448e0) AS INT))) AS INT) AS row_ FROM t),
          k AS (SELECT *, unnest([0, 1, 0, 1]) AS i, unnest([0, 0, 1, 1]) AS j FROM u),
          q AS (SELECT *, p * ((col + i) * 448) + p * turn * ((row_ + j) * 448) + x0 AS x, p * turn * ((col + i) * 448) - p * 1.25e0 * ((row_ + j) * 448) + y0 AS y FROM k)
          SELECT scene_id, col, row_, round(min({_LON.format("x")}), 9) AS min_lon, round(min({_LAT.format("y")}), 9) AS min_lat, round(max({_LON.format("x")}), 9) AS max_lon, round(max({_LAT.format("y")}), 9) AS max_lat FROM q GROUP BY scene_id, col, row_""",
        "tree_digest": """WITH f AS (SELECT substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS g, lpad(CAST(doc_id AS VARCHAR), 20, '0') AS o, concat_ws('|', CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR), lang) AS l FROM {documents}),
          e AS (SELECT g, sha256(string_agg(l, chr(10) ORDER BY o, l)) AS d, count(*) AS n FROM f GROUP BY g) SELECT sha256(string_agg(d, '' ORDER BY g, d)) AS digest, CAST(sum(n) AS BIGINT) AS files FROM e""",
        "contained_rasters": """WITH r AS (SELECT p_partkey AS raster_id, p_brand || '/' || p_size AS grid, p_partkey % 7 * 64 AS x0, p_partkey % 5 * 64 AS y0, p_partkey % 11 * 64 + 128 AS width, p_partkey % 13 * 64 + 128 AS height FROM {part})
          SELECT a.raster_id AS in_raster_id, b.raster_id AS out_raster_id, a.x0 - b.x0 AS dx, a.y0 - b.y0 AS dy FROM r a JOIN r b ON a.grid = b.grid AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x0 + a.width <= b.x0 + b.width AND a.y0 + a.height <= b.y0 + b.height
          WHERE a.width * a.height < b.width * b.height OR (a.width * a.height = b.width * b.height AND a.raster_id > b.raster_id)""",
        "equal_pixels": """SELECT a.raster_id AS in_raster_id, CAST(a.raster_id + 1 AS INT) AS out_raster_id, count(*) AS pixels, bool_and(coalesce(a.b1 = b.b1 AND a.b2 = b.b2 AND a.b3 = b.b3, false)) AS same
          FROM {pixels} a LEFT JOIN {pixels} b ON b.raster_id = a.raster_id + 1 AND a.x = b.x AND a.y = b.y GROUP BY 1, 2""",
        "raster_duplicates": f"""WITH {_LEVELS}, k AS (SELECT *, {_KIND} AS kind FROM {{scenes}}),
          r AS (SELECT p_partkey AS raster_id, p_brand || '/' || p_size AS grid, p_partkey % 7 * 64 AS x0, p_partkey % 5 * 64 AS y0, p_partkey % 11 * 64 + 128 AS width, p_partkey % 13 * 64 + 128 AS height, kind, levels.reason AS pixel,
            round(CASE kind WHEN 'mercator' THEN px * cos(radians(lat)) WHEN 'projected' THEN px END, 9) AS gsd FROM {{part}} JOIN k ON scene_id = p_partkey LEFT JOIN levels ON levels.raster_id = p_partkey),
          c AS (SELECT * FROM r WHERE pixel IS NULL AND kind <> 'none'),
          pairs AS (SELECT a.raster_id AS i, b.raster_id AS o, a.x0 - b.x0 AS dx, a.y0 - b.y0 AS dy, b.width * b.height AS area FROM c a JOIN c b ON a.grid = b.grid AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x0 + a.width <= b.x0 + b.width AND a.y0 + a.height <= b.y0 + b.height
            WHERE a.width * a.height < b.width * b.height OR (a.width * a.height = b.width * b.height AND a.raster_id > b.raster_id)),
          held AS (SELECT i, o, area FROM pairs JOIN {{pixels}} p ON p.raster_id = i LEFT JOIN {{pixels}} q ON q.raster_id = o AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY i, o, area HAVING bool_and(coalesce(p.b1 = q.b1 AND p.b2 = q.b2 AND p.b3 = q.b3, false))),
          one AS (SELECT i, arg_min(o, (-area, o)) AS duplicate_of FROM held WHERE o NOT IN (SELECT i FROM held) GROUP BY i)
          SELECT raster_id, duplicate_of, CASE WHEN pixel IS NOT NULL THEN pixel WHEN kind = 'none' THEN 'not_georeferenced' WHEN duplicate_of IS NOT NULL THEN 'duplicate'
            WHEN gsd IS NULL OR NOT gsd BETWEEN 0.05 AND 0.15 THEN 'gsd_out_of_range' END AS reason FROM r LEFT JOIN one ON i = raster_id""",
        # untouched pixels of one picture are equal wherever crops overlap, so a pair differs where a change of one lies on the other and is not shared
        "crop_duplicates": """WITH r AS (SELECT p_partkey AS id, p_brand AS grid, p_partkey % 7 * 4 AS x0, p_partkey % 5 * 4 AS y0, p_partkey % 11 * 4 + 8 AS w, p_partkey % 13 * 4 + 8 AS h,
            CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 7 * 4 + p_partkey % 7 END AS cx, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 5 * 4 + p_partkey % 8 END AS cy FROM {part}),
          q AS (SELECT *, CASE WHEN id % 7 < w THEN cx END AS tx, CASE WHEN id % 7 < w THEN cy END AS ty FROM r),
          held AS (SELECT a.id AS i, b.id AS o, b.w * b.h AS area FROM q a JOIN q b ON a.grid = b.grid AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x0 + a.w <= b.x0 + b.w AND a.y0 + a.h <= b.y0 + b.h
            WHERE (a.w * a.h < b.w * b.h OR (a.w * a.h = b.w * b.h AND a.id > b.id))
              AND (a.tx IS NULL OR (a.tx = b.tx AND a.ty = b.ty) IS TRUE) AND (b.tx IS NULL OR NOT (b.tx BETWEEN a.x0 AND a.x0 + a.w - 1 AND b.ty BETWEEN a.y0 AND a.y0 + a.h - 1) OR (a.tx = b.tx AND a.ty = b.ty) IS TRUE))
          SELECT i AS raster_id, arg_min(o, (-area, o)) AS duplicate_of FROM held WHERE o NOT IN (SELECT i FROM held) GROUP BY i""",
        "tile_windows": """WITH r AS (SELECT p_partkey AS id, p_partkey % 7 * 4 AS x0, p_partkey % 5 * 4 AS y0, p_partkey % 11 * 4 + 8 AS w, p_partkey % 13 * 4 + 8 AS h FROM {part}),
          t AS (SELECT *, unnest(range(0, w, 16)) AS px FROM r), u AS (SELECT *, unnest(range(0, h, 16)) AS py FROM t), k AS (SELECT *, unnest(range(768)) AS k FROM u),
          v AS (SELECT id, px, py, k, px + (k % 48) // 3 AS x, py + k // 48 AS y, k % 3 AS b, w, h, x0, y0 FROM k),
          c AS (SELECT *, CASE WHEN x >= w OR y >= h THEN 0 ELSE ((x0 + x) * 7 + (y0 + y) * 13 + b * 5 + CASE WHEN id % 5 = 0 AND y = id % 8 AND x = id % 7 AND b = 1 THEN 1 ELSE 0 END) % 251 END AS value FROM v)
          SELECT id || '_' || px || '_' || py AS tile_id, count(*) AS bytes, md5(unhex(string_agg(printf('%02x', CAST(value AS INT)), '' ORDER BY k))) AS digest FROM c GROUP BY id, px, py""",
        "copy_check": """WITH r AS (SELECT p_partkey AS id, p_partkey % 11 * 4 + 8 AS w, p_partkey % 13 * 4 + 8 AS h FROM {part}),
          s AS (SELECT *, list_distinct([0, CAST(round_even((w - 4) / 2e0, 0) AS INT), w - 4]) AS xs, list_distinct([0, CAST(round_even((h - 4) / 2e0, 0) AS INT), h - 4]) AS ys FROM r)
          SELECT id AS source_id, -1 - id AS copy_id, id % 9 <> 5 AS headers, CAST(len(xs) * len(ys) AS INT) AS windows,
            CASE WHEN id % 9 = 4 THEN len(list_filter(xs, lambda x: id % w BETWEEN x AND x + 3)) * len(list_filter(ys, lambda y: id % h BETWEEN y AND y + 3)) ELSE 0 END AS differing FROM s""",
        "path_keys": """WITH k AS (SELECT p_partkey, 'area' || p_partkey % 5 || '/' || p_brand || '/2024-01-0' || (1 + p_partkey % 9) || CASE WHEN p_size % 2 = 0 THEN '.TIF' ELSE '.jp2' END AS key, 'area' || p_partkey % 5 AS aoi, p_size, '2024-01-0' || (1 + p_partkey % 9) AS d FROM {part})
          SELECT p_partkey, key, aoi, CASE WHEN p_size % 2 = 0 THEN d ELSE 'unknown' END AS acq_date FROM k""",
    }.items()
}
