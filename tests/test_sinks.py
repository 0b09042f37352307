"""Tables that are written for users, and what the session has to say where they lie."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tilespark.functions.text import number_type
from tilespark.operators import packing
from tilespark.session import setting
from tilespark.sources import corpus, sinks


def test_inventory_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b.tif", 10, None), ("a.tif", 20, "too small")], "path string, width int, reason string")
    where = f"{tmp_path}/inventory"
    sinks.write_inventory(rows, where, str(tmp_path))
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(where).collect())) == sorted(map(tuple, rows.collect()))
    sinks.write_inventory(rows.filter("width > 10"), where, str(tmp_path))
    assert spark.read.json(where).count() == 1  # written anew, not added to
    for outside in ("/elsewhere/x", f"{tmp_path}/../x", str(tmp_path)):
        with pytest.raises(sinks.OutsideRoot):
            sinks.write_inventory(rows, outside, str(tmp_path))


def test_plans_are_parted_by_area_and_scale(spark, tmp_path):
    tiles = spark.range(60).selectExpr("concat('t', id) AS tile_id", "concat('area ', id % 2) AS aoi", "CAST(112 * (1 + id % 3) AS INT) AS scale")
    where = f"{tmp_path}/plans"
    sinks.write_tile_plans(tiles, where, str(tmp_path))
    back = spark.read.parquet(where)
    assert back.select(tiles.columns).exceptAll(tiles).count() == 0 and back.count() == 60
    one = back.filter("aoi = 'area 1' AND scale = 224")
    assert one.count() == 10 and "PartitionFilters: [isnotnull(aoi" in one._jdf.queryExecution().toString()
    assert len(one.inputFiles()) >= 1 and sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(where)) == 6  # a file for each area and scale


def test_tracks_are_written_a_row_each(spark, tmp_path):
    boxes = spark.createDataFrame([("c", 1, f, 1.0 * f, 2.0, 3.0 + f, 4.0) for f in (9, 10, 2)] + [("d", 1, 0, 0.0, 0.0, 1.0, 1.0)], "clip_id string, track_id int, frame int, x1 double, y1 double, x2 double, y2 double")
    sinks.write_tracks(boxes, f"{tmp_path}/tracks", str(tmp_path))
    rows = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/tracks").collect()]
    assert sorted((r["clip_id"], r["track_id"], len(r["boxes"])) for r in rows) == [("c", 1, 3), ("d", 1, 1)]
    assert next(r for r in rows if r["clip_id"] == "c")["boxes"]["10"] == [10.0, 2.0, 13.0, 4.0]


def test_a_tree_is_scanned(spark, tmp_path):
    for p in ("a/x.tif", "a/b/y.TIFF", "z.tif"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * len(p))
    found = corpus.scan_tree(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["size" if "size" in found.columns else "length"] for r in found.collect()} == {"x.tif": 7, "y.TIFF": 10, "z.tif": 5}


def test_settings(spark):
    spark.conf.set("tilespark.data.root", "/somewhere")
    try:
        assert setting(spark, "data.root") == "/somewhere" and setting(spark, "index.root", "index") == "index"
        spark.conf.set("tilespark.data.root", "")
        with pytest.raises(ValueError, match="tilespark.data.root"):
            setting(spark, "data.root")
    finally:
        spark.conf.unset("tilespark.data.root")


def test_number_types(spark):
    rows = spark.createDataFrame([("cuda", 7), ("cuda", 8), ("cuda", 9), ("cpu", 9), ("mps", None)], "device string, major int")
    assert [r[0] for r in rows.select(number_type(F.col("device"), F.col("major"))).collect()] == ["float16", "bfloat16", "bfloat16", "float32", "float32"]


def test_opening_phrases(spark):
    areas = spark.createDataFrame([("north",), ("south",), ("north",)], "aoi string")
    phrases = spark.createDataFrame([(0, "a car"), (1, "a ship"), (2, "a car")], "at int, phrase string")
    chosen = spark.createDataFrame([("north", "a ship")], "aoi string, phrase string")
    found = packing.opening_phrases(areas, phrases, chosen, "a car")
    assert sorted(map(tuple, found.collect())) == [("north", "a ship", 1), ("south", "a car", 0)]
    with pytest.raises(Exception, match="not among the phrases: a tree"):
        packing.opening_phrases(areas, phrases, chosen, "a tree").collect()
