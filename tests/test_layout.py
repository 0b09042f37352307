"""Tile plans, ground resolution and inventories against known numbers."""

import math

import random

import pytest
from pyspark.sql import functions as F

from tilespark.functions import geometry as g
from tilespark.functions import text as t
from tilespark.operators import export, inventory, tiling, tracks
from tilespark.sources import sinks


def scenes(spark, *sizes):
    return spark.createDataFrame([(i, w, h, "a", "unknown") for i, (w, h) in enumerate(sizes)], "scene_id long, width int, height int, aoi string, acq_date string")


def test_counts_of_known_rasters(spark):
    assert tiling.tile_plan(scenes(spark, (20179, 9784)), (448,)).count() == 46 * 22 == 1012
    assert tiling.tile_plan(scenes(spark, (10240, 10240))).count() == 11_109
    one = tiling.tile_plan(scenes(spark, (896, 896)))
    assert {r["scale"]: r["count"] for r in one.groupBy("scale").count().collect()} == {448: 4, 224: 16, 112: 64}
    assert one.filter("is_edge").count() == 0


def test_tiles_cover_the_raster_once(spark):
    r = tiling.tile_plan(scenes(spark, (1000, 700))).groupBy("scale").agg(F.sum(F.col("valid_w") * F.col("valid_h")).alias("px")).collect()
    assert all(x.px == 700_000 for x in r)


def test_long_indices_are_not_cut(spark):
    r = spark.range(1).select(g.tile_id(F.lit("a"), F.lit("s"), F.lit("d"), F.lit(112), F.lit(123456), F.lit(7)).alias("tile_id"))
    p = tiling.parsed_ids(r).collect()[0]
    assert p.tile_id == "a::s::d::112::123456::00007" and (p.px_x, p.px_y) == (123456 * 112, 784)


@pytest.mark.parametrize("size", [(3840, 2160), (1920, 1080), (448, 448), (449, 447), (1000, 1), (1, 1)])
@pytest.mark.parametrize("overlap", [0.0, 0.2, 0.5])
def test_overlapping_tiles_reach_the_edges(spark, size, overlap):
    f = spark.createDataFrame([(1, *size)], "frame_id long, width int, height int")
    rows = tiling.frame_tiles(f, 448, overlap).collect()
    for lo, hi, n in (("x0", "x1", size[0]), ("y0", "y1", size[1])):
        spans = sorted({(r[lo], r[hi]) for r in rows})
        assert spans[0][0] == 0 and max(b for _, b in spans) == n and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))


def test_bad_arguments(spark):
    for tile, overlap in ((0, 0.2), (448, 1.0), (448, -0.1)):
        with pytest.raises(ValueError):
            g.starts(F.lit(10), tile, overlap)


def test_ground_resolution(spark):
    kinds = spark.createDataFrame([("WGS 84 / Pseudo-Mercator",), ("WGS 84 / UTM zone 36N",), ("Transverse Mercator",), ("Geographic WGS 84",), (None,)], "crs string")
    assert [r[0] for r in kinds.select(g.crs_kind(F.col("crs"))).collect()] == ["mercator", "projected", "projected", "geographic", "none"]
    gsd = spark.range(1).select((F.lit(0.125002) * g.scale_correction(F.lit("mercator"), F.lit(33.10707))).alias("v")).collect()[0].v
    assert abs(gsd * 100 - 10.47) < 0.01 and abs(gsd * 448 - 46.91) < 0.05
    a, b = spark.range(1).select(*g.geodesic_pixel(F.lit(0.0), F.lit(1.0), F.lit(1.0))).collect()[0]
    assert abs(a - 111319.49) < 0.01 and abs(b - 110574.27) < 0.5


def test_mercator_inverse(spark):
    lon, lat = spark.range(1).select(g.mercator_lon(F.lit(math.pi * g.EARTH_RADIUS)), g.mercator_lat(F.lit(math.pi * g.EARTH_RADIUS))).collect()[0]
    assert lon == pytest.approx(180) and lat == pytest.approx(85.0511287798)


def test_pixel_rule(spark):
    cases = [(3, [65, 65, 65], None), (3, [64, 65, 65], "derived_raster"), (3, [65, 64, 65], "derived_raster"), (4, [200, 200, 200, 1], None), (1, [238], "too_few_bands"), (2, [99, 99], "too_few_bands")]
    df = spark.createDataFrame(cases, "bands int, levels array<int>, want string")
    for r in df.select("want", inventory.pixel_reason(F.col("bands"), F.col("levels")).alias("got"), inventory.is_imagery(F.col("bands"), F.col("levels")).alias("ok")).collect():
        assert r.got == r.want and r.ok == (r.want is None)


def test_duplicates_are_verified_and_never_chained(spark):
    value = lambda x, y: (x * 7 + y * 13 + x * y) % 101
    # number, group, corner and size; 9 is the original of its crop 2, whose crop is 17; 30 is a copy of 9; 5 lies inside with another pixel; 21 is of another group
    rasters = [(9, "g", 10, 20, 8, 8), (2, "g", 12, 21, 5, 6), (17, "g", 13, 23, 3, 3), (30, "g", 10, 20, 8, 8), (5, "g", 11, 22, 4, 4), (21, "h", 12, 21, 5, 6), (40, "g", 10, 20, 4, 8)]
    pixels = [(i, x, y, value(x0 + x, y0 + y) + (i == 5 and x == y == 2)) for i, _, x0, y0, w, h in rasters for x in range(w) for y in range(h)]
    pixels = [(i, x, y, None if (i, x, y) == (40, 1, 1) else v) for i, x, y, v in pixels]
    r = spark.createDataFrame(rasters, "raster_id int, grid string, x0 int, y0 int, width int, height int")
    got = inventory.duplicates(r, spark.createDataFrame(pixels, "raster_id int, x int, y int, b1 long"))
    assert {x.raster_id: x.duplicate_of for x in got.collect()} == {2: 9, 17: 9, 30: 9}


def test_order_of_reasons(spark):
    r = lambda p, geo, dup, gsd: spark.range(1).select(inventory.index_reason(F.lit(p).cast("string"), F.lit(geo), F.lit(dup), F.lit(gsd))).collect()[0][0]
    assert r("too_few_bands", False, True, 9.0) == "too_few_bands" and r(None, False, True, 9.0) == "not_georeferenced"
    assert r(None, True, True, 9.0) == "duplicate" and r(None, True, False, 0.16) == "gsd_out_of_range"
    assert r(None, True, False, 0.05) is None and r(None, True, False, 0.15) is None


def test_touching_boxes_meet_and_inverted_ones_do_not(spark):
    hit = lambda q: spark.range(1).select(g.intersects(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0), q)).collect()[0][0]
    assert hit((2.0, 2.0, 3.0, 3.0)) and hit((0.0, 0.0, 1.0, 1.0)) and not hit((2.1, 0.0, 3.0, 3.0)) and not hit((3.0, 3.0, 0.0, 0.0))


def test_paths(spark):
    df = spark.createDataFrame([("a\\b\\2024-03-01.tif",), ("./x//y.TIFF",), ("alone.tif",), ("2024-03-01/z.tif",)], "p string")
    got = df.select(t.posix_key(F.col("p")).alias("k")).select("k", t.scene_aoi(F.col("k")).alias("a"), t.scene_date(F.col("k")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("a/b/2024-03-01.tif", "a", "2024-03-01"), ("x/y.TIFF", "x", "unknown"), ("alone.tif", "alone", "unknown"), ("2024-03-01/z.tif", "2024-03-01", "unknown")]


def test_model_boxes_keep_leading_zeros(spark):
    df = spark.createDataFrame([("see [040,482,112,576] and [1, 2]",), ("nothing",)], "s string")
    assert [r[0] for r in df.select(t.model_boxes(F.col("s"))).collect()] == [[[0.040, 0.482, 0.112, 0.576]], []]


def test_words_and_directions(spark):
    row = spark.range(1).select(t.lexical_similarity(F.lit("red car"), F.lit("a red cart")), t.octant(F.lit(0.0), F.lit(1.0)), t.octant(F.lit(1.0), F.lit(-1.0)), t.signed_score(F.lit(0.12345))).collect()[0]
    # the phrase holds the query (10), equal words (3), "car" in "cart" (0.5), "a" in "car" (0.5)
    assert tuple(row) == (14.0, "south", "northeast", "+0.1235") or tuple(row) == (14.0, "south", "northeast", "+0.1234")


def test_phases(spark):
    rows = [(1, f, 10.0 * min(f, 30), 0.0) for f in range(60)]
    p = tracks.phases(spark.createDataFrame(rows, "user_id long, frame long, x double, y double"), 10.0)
    assert [(r.state, r.start_frame, r.end_frame) for r in p.orderBy("phase").collect()] == [("moves east", 0, 30), ("stationary", 30, 59)]
    assert tracks.described(p, 10.0).collect()[0].text == "moves east (0.0-3.0s); stationary (3.0-5.9s)."


def test_export_ladder():
    maps = [(4096, 9_000_000), (2048, 3_000_000), (512, 200_000)]
    assert export.fitting(9631, 226, 16 << 20, [384, 256, 128], maps, 1024) == (384, 2048)
    assert export.fitting(9631, 226, 2_600_000, [384, 256, 128], maps, 1024) == (128, 512)
    with pytest.raises(ValueError):
        export.fitting(9631, 226, 1000, [128], maps, 1024)


def test_targets_outside_the_root():
    assert sinks.guarded("/data/index/a", "/data/index") == "/data/index/a"
    for bad in ("/data/other", "/data/index/../x", "/data/index", "../index"):
        with pytest.raises(sinks.OutsideRoot):
            sinks.guarded(bad, "/data/index")


def test_page_round_trip():
    text = sinks.page("a<b", {"x": "</script>", "n": [1, 2]}, 10_000)
    assert sinks.data_of(text) == {"x": "</script>", "n": [1, 2]}
    with pytest.raises(ValueError):
        sinks.page("t", {"x": "y" * 100}, 50)
    with pytest.raises(ValueError):
        sinks.packed([300], "uint8")


def picture(w, h, bands, dx=0, dy=0):
    return [[tuple((7 * (x + dx) + 13 * (y + dy) + 5 * b) % 251 for b in range(bands)) for x in range(w)] for y in range(h)]


def strips_of(spark, rasters):
    rows = [(i, y, len(p[0][0]), bytes(v for px in row for v in px)) for i, p in rasters.items() for y, row in enumerate(p)]
    return spark.createDataFrame(rows, "raster_id int, y int, pixel_bytes int, data binary")


def test_strips_compare_every_band_and_byte(spark):
    inner = picture(10, 70, 3, 2, 1)
    rasters = {1: picture(20, 90, 3), 2: inner, 4: picture(10, 70, 4, 2, 1), 5: picture(10, 70, 3, 3, 1)}
    for i, (y, x, b) in enumerate([(0, 0, 1), (69, 9, 2), (33, 4, 0)]):  # one byte of one band, first, last and between
        p = [list(row) for row in inner]
        p[y][x] = tuple(v ^ 1 if k == b else v for k, v in enumerate(p[y][x]))
        rasters[10 + i] = p
    pairs = spark.createDataFrame([(i, 1, 2, 1) for i in (*rasters, 99) if i != 1] + [(1, 2, 0, 0)], "in_raster_id int, out_raster_id int, dx int, dy int")
    for first_of in (1, 64, 1000):
        got = {(r.in_raster_id, r.out_raster_id): (r.strips, r.same) for r in inventory.same_strips(pairs, strips_of(spark, rasters), first_of).collect()}
        assert got.pop((2, 1)) == (70, True) and len(got) == 7 and not any(same for _, same in got.values())


def test_strips_agree_with_pixels(spark):
    rng = random.Random(3)
    rows, rasters = [], {}
    for i in range(40):
        x0, y0, w, h, = rng.randrange(4), rng.randrange(4), rng.randrange(2, 9), rng.randrange(2, 9)
        p = picture(w, h, 2, x0, y0)
        if i % 3 == 0:
            p[rng.randrange(h)][rng.randrange(w)] = (250, 250)
        rows.append((i, "g", x0, y0, w, h))
        rasters[i] = p
    r = spark.createDataFrame(rows, "raster_id int, grid string, x0 int, y0 int, width int, height int")
    pixels = spark.createDataFrame([(i, x, y, *px) for i, p in rasters.items() for y, row in enumerate(p) for x, px in enumerate(row)], "raster_id int, x int, y int, b1 int, b2 int")
    by_pixel, by_strip = ({tuple(x) for x in d.collect()} for d in (inventory.duplicates(r, pixels), inventory.duplicates(r, strips_of(spark, rasters), inventory.same_strips)))
    assert by_pixel == by_strip and len(by_pixel) > 5


def test_a_copy_is_its_source(spark):
    source = picture(30, 20, 3)
    def changed(y, x):
        p = [list(row) for row in source]
        p[y][x] = (9, 9, 9)
        return p
    rasters = {1: source, 2: source, 3: changed(0, 0), 4: changed(8, 13), 5: changed(4, 8), 6: source, 7: picture(30, 19, 3)}
    heads = [(i, 30, len(p), "utm" if i != 6 else None) for i, p in rasters.items()]
    pairs = spark.createDataFrame([(1, i) for i in range(2, 9)], "source_id int, copy_id int")
    found = inventory.copy_check(pairs, spark.createDataFrame(heads, "raster_id int, width int, height int, crs string"), strips_of(spark, rasters), window=4, grid=3)
    got = {r.copy_id: (r.headers, r.windows, r.differing) for r in found.collect()}
    # windows begin at 0, 13, 26 and at 0, 8, 16
    assert {i: got[i] for i in (2, 3, 4, 5, 7)} == {2: (True, 9, 0), 3: (True, 9, 1), 4: (True, 9, 1), 5: (True, 9, 0), 7: (False, 9, 3)}
    assert not got[6][0] and got[6][2] == 0 and got[8][2] == 9 and not got[8][0]
    assert inventory.checked_copies(found.filter("copy_id IN (2, 5)")).count() == 2
    with pytest.raises(Exception, match="copy 3 is not its source 1"):
        inventory.checked_copies(found.filter("copy_id = 3")).collect()


def test_containment_at_every_size(spark):
    rng = random.Random(12)
    rows = [(0, "g", -70_000, -70_000, 200_000, 200_000), (1, "g", 0, 0, 1, 1), (2, "g", -1, -1, 1, 1), (3, "h", 0, 0, 1, 1)]
    for i in range(4, 300):
        side = 2 ** rng.randrange(12)
        x, y = rng.randrange(-2000, 2000) // 8 * 8, rng.randrange(-2000, 2000) // 8 * 8
        rows.append((i, rng.choice("gh"), x, y, rng.choice([side, max(1, side - 1), side + 1]), rng.choice([side, max(1, side // 3)])))
    r = spark.createDataFrame([(i, g_, x, y, w, h) for i, g_, x, y, w, h in rows], "raster_id int, grid string, x0 int, y0 int, width int, height int").repartition(4)
    want = {(a[0], b[0], a[2] - b[2], a[3] - b[3]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0] and a[2] >= b[2] and a[3] >= b[3] and a[2] + a[4] <= b[2] + b[4] and a[3] + a[5] <= b[3] + b[5] and (a[4] * a[5], -a[0]) < (b[4] * b[5], -b[0])}
    got = [tuple(x) for x in inventory.contained(r).collect()]
    assert len(want) > 200 and len(got) == len(set(got)) and set(got) == want
