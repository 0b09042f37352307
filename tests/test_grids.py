"""Affine grids, ground resolution and its guard on cases worked out apart."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tilespark.operators import grids

SCENES = "scene_id int, kind string, zone int, south boolean, transform array<double>, width int, height int"


def scenes(spark, *rows):
    return spark.createDataFrame(list(rows), SCENES)


def metres(lat):
    """Metres of a degree of longitude and of latitude on the ellipsoid."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    w = math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
    return a / w * math.cos(math.radians(lat)) * math.pi / 180, a * (1 - e2) / w**3 * math.pi / 180


def test_resolution_on_both_axes(spark):
    y = 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(31.5) / 2))
    rows = scenes(
        spark,
        (1, "mercator", None, None, [0.12, 0.0, 3_900_000.0 - 600, 0.0, -0.1, y + 400], 10_000, 8_000),
        (2, "geographic", None, None, [1e-6, 0.0, 34.0, 0.0, -2e-6, 31.0], 0, 0),
        (3, "projected", 36, False, [0.05, 0.0, 650_000.0, 0.0, -0.08, 3_500_000.0], 2000, 2000),
        (4, "none", None, None, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], 10, 10),
        (5, "mercator", None, None, None, 10, 10),
        (6, "projected", None, None, [0.3, 0.0, 5.0, 0.0, -0.3, 5.0], 10, 10),
    )
    got = {r.scene_id: r for r in grids.ground_resolution(rows).collect()}
    c = math.cos(math.radians(31.5))
    assert (got[1].centre_lat, got[1].gsd_x, got[1].gsd_y) == (pytest.approx(31.5), pytest.approx(0.12 * c), pytest.approx(0.1 * c)) and got[1].geodesic == pytest.approx(0.11 * c, rel=0.006)
    across, along = metres(31.0)
    assert (got[2].gsd_x, got[2].gsd_y) == (pytest.approx(1e-6 * across, rel=1e-6), pytest.approx(2e-6 * along, rel=1e-6)) and got[2].gsd == got[2].geodesic
    assert (got[3].gsd_x, got[3].gsd_y, got[3].gsd) == (0.05, 0.08, pytest.approx(0.065)) and got[3].geodesic == pytest.approx(0.065, rel=1e-3)
    assert all(got[i].gsd is None for i in (4, 5)) and (got[6].gsd, got[6].geodesic) == (0.3, None)


def test_a_wrong_rule_stops_the_plan(spark):
    far = (7, "projected", 36, False, [0.05, 0.0, 1_900_000.0, 0.0, -0.05, 3_500_000.0], 100, 100)  # much too far from its zone for a factor of 1
    assert grids.ground_resolution(scenes(spark, far), guard=False).collect()[0].geodesic < 0.049
    with pytest.raises(Exception, match=r"scene 7 \(projected\): 5.0000 cm by rule"):
        grids.ground_resolution(scenes(spark, far)).collect()


def test_boxes_of_turned_grids_share_their_corners(spark):
    turned = [0.11, 0.03, 3_785_000.0, 0.02, -0.17, 3_630_000.0]
    s = scenes(spark, (1, "mercator", None, None, turned, 1000, 700), (2, "projected", 36, False, [0.05, 0.01, 650_000.0, 0.01, -0.05, 3_500_000.0], 1000, 700), (3, "geographic", None, None, [1e-6, 0.0, 34.0, 0.0, 1e-6, 31.0], 300, 300))
    plan = spark.range(3).select((F.col("id") + 1).cast("int").alias("scene_id"), F.lit(100).alias("scale"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row_")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(5)))).repartition(5)
    got = {(r.scene_id, r.col, r.row_): r for r in grids.tile_boxes(plan, s).collect()}
    assert len(got) == 90
    a, b, c, d, e, f = turned
    for col, row in itertools.product(range(6), range(5)):
        points = [(a * i + b * j + c, d * i + e * j + f) for i in (100 * col, 100 * col + 100) for j in (100 * row, 100 * row + 100)]
        lons, lats = [math.degrees(x / 6378137.0) for x, _ in points], [math.degrees(math.atan(math.sinh(y / 6378137.0))) for _, y in points]
        r = got[1, col, row]
        assert (r.min_lon, r.min_lat, r.max_lon, r.max_lat) == pytest.approx((min(lons), min(lats), max(lons), max(lats)), abs=1e-12)
        own = got[3, col, row]  # an upright grid whose rows go north
        if col < 5:
            assert own.max_lon == got[3, col + 1, row].min_lon
        if row < 4:
            assert own.max_lat == got[3, col, row + 1].min_lat
    assert all(30 < r.min_lat < 33 and 34 < r.min_lon < 36 for (i, _, _), r in got.items() if i == 2)


def test_tiles_of_an_unknown_scene(spark):
    s = scenes(spark, (1, "mercator", None, None, None, 10, 10))
    tiles = spark.createDataFrame([("t", 1), ("u", 1)], "tile_id string, scene_id int")
    assert {(r.tile_id, r.kind) for r in grids.with_scene(tiles, s, ["kind"]).collect()} == {("t", "mercator"), ("u", "mercator")}
    with pytest.raises(Exception, match="no scene 2"):
        grids.with_scene(spark.createDataFrame([("t", 2)], "tile_id string, scene_id int"), s, ["kind"]).collect()
