import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.plans.engine import BadRequest, Engine, HashedWords, checked_box, checked_query, clamped, cleaned
from tilespark.sources import rasters
from tilespark.sources.views import table

from .conftest import SMALL


@pytest.fixture(scope="module")
def engine(spark):
    where = table(spark, SMALL, "tile_grid").select("vec_id", "min_lon", "min_lat", "max_lon", "max_lat")
    corpus = table(spark, SMALL, "vec_corpus").join(where, "vec_id")
    background = spark.createDataFrame([(f"aoi_{i % 4}", s, 0.01 * i) for i in range(30) for s in (112, 224, 448)], "aoi string, scale int, top1 double")
    return Engine(spark, {"whole": corpus}, {"whole": HashedWords(64)}, {"whole": background})


def test_answer(engine):
    a = engine.answer("  a red car ", "whole", top_k=3)
    hits = a["hits"].collect()
    assert a["query"] == "a red car" and not a["truncated"] and len(hits) == 9
    for s in (112, 224, 448):
        own = sorted((h for h in hits if h["scale"] == s), key=lambda h: h["rank"])
        assert [h["rank"] for h in own] == [1, 2, 3] and own[0].score >= own[1].score >= own[2].score
    assert {r.band for r in a["scales"].collect()} <= {"low", "medium", "high"}


def test_date_narrows_the_corpus_and_a_box_only_the_hits(engine):
    whole = {r["scale"]: r.corpus_size for r in engine.answer("x", "whole")["scales"].collect()}
    dated = {r["scale"]: r.corpus_size for r in engine.answer("x", "whole", date="2025-06-06")["scales"].collect()}
    boxed = engine.answer("x", "whole", bbox=(34.0, 30.9, 34.01, 31.0))
    assert all(dated[s] < whole[s] for s in dated)
    assert {r["scale"]: r.corpus_size for r in boxed["scales"].collect()} == whole
    assert engine.answer("x", "whole", bbox=(35.0, 31.0, 34.0, 30.0))["hits"].count() == 0
    assert engine.answer("x", "whole", date="any")["scales"].count() == 3


def test_models_side_by_side(engine):
    a, b = engine.compare("x", ["whole", "none"])
    assert a["available"] and a["hits"].count() and b == {"model_id": "none", "available": False}


def test_areas_and_dates(engine):
    assert engine.dates("whole") == ["2022-10-29", "2025-06-06"]
    with pytest.raises(BadRequest):
        engine.corpus("whole", "nowhere")
    with pytest.raises(BadRequest):
        engine.corpus("nothing")


def test_arguments():
    assert [clamped(k) for k in (-1, 5, 999)] == [1, 5, 200]
    assert cleaned("x" * 2001) == ("x" * 2000, True)
    for f in (lambda: cleaned(" \n"), lambda: checked_box((1, 2, 3)), lambda: checked_box((1, 2, 3, float("nan"))), lambda: checked_query([1.0, 1.0]), lambda: checked_query([float("nan")])):
        with pytest.raises(BadRequest):
            f()
    assert np.linalg.norm(HashedWords(8).embed("some words here")) == pytest.approx(1)


def _probe(path):
    if path.endswith(".txt"):
        return None
    if path.endswith("bad.tif"):
        raise OSError("cut short")
    return {"width": 10, "height": 20, "band_count": 3, "crs": "x", "px": 0.1, "distinct_per_band": [65, 70, 80]}


def test_probing_records_failures(spark):
    files = spark.createDataFrame([("a.tif",), ("b.txt",), ("bad.tif",)], "path string")
    got = {r.path: r for r in rasters.probed(files, _probe).collect()}
    assert (got["a.tif"].outcome, got["a.tif"].height) == ("opened", 20) and got["b.txt"].outcome == "not_a_raster"
    assert got["bad.tif"].outcome == "unreadable" and "cut short" in got["bad.tif"].error


def _mean_model(pixels):
    return np.array([[sum(p) + 1.0, len(p)] for p in pixels])


def test_embedding_skips_empty_tiles_and_checks_shapes(spark):
    tiles = spark.createDataFrame([("t1", 0.0, [1, 2]), ("t2", 1.0, [0, 0]), ("t3", 0.5, [5, 5])], "tile_id string, nodata_fraction double, px array<int>")
    got = {r.tile_id: r.embedding for r in rasters.embedded(tiles, "px", _mean_model, 2).collect()}
    assert got.keys() == {"t1", "t3"} and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())
    with pytest.raises(Exception, match="the model gave"):
        rasters.embedded(tiles, "px", _mean_model, 3).collect()


def test_windows_are_padded_with_zeros(spark):
    tiles = spark.createDataFrame([("t", 1, 3, 2, 0)], "tile_id string, scene_id long, scale int, px_x int, px_y int")
    pixels = spark.range(12).select(F.lit(1).cast("long").alias("scene_id"), (F.col("id") % 4).cast("int").alias("x"), (F.col("id") / 4).cast("int").alias("y"), F.lit(7).alias("value"))
    rows = rasters.padded_windows(pixels, tiles).collect()
    assert len(rows) == 9 and sum(r.value for r in rows) == 7 * 6
