"""What is built and loaded again: round trips, and the errors that a load raises instead of repairing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions import geometry as g
from tilespark.operators import ranking, tiling
from tilespark.sources import artifacts, corpus


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [("m", "r", f"a{i % 2}", f"a{i % 2}::{i}", 224 if i % 4 < 2 else 112, 0.0, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, corpus.VECTORS.replace("model_id string, revision string, aoi string", "model_id string, revision string, aoi string")).cache()


@pytest.fixture(scope="module")
def plan(vectors):
    return vectors.select("tile_id", F.lit("s").alias("source"), F.lit(0.1).alias("gsd_m"))


def asked(spark, n=6):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(n, 8))
    return spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")


def test_corpus_is_loaded_and_located(spark, vectors, plan, tmp_path):
    path = f"{tmp_path}/v"
    corpus.write_vectors(vectors, path)
    both = artifacts.load_corpus(spark, path, plan, "m")
    assert both.count() == 120 and {r.source for r in both.select("source").distinct().collect()} == {"s"}
    assert artifacts.load_corpus(spark, path, plan, "m", ["a1"]).count() == 60
    with pytest.raises(artifacts.MissingTiles, match="a0::0"):
        artifacts.load_corpus(spark, path, plan.filter("tile_id NOT IN ('a0::0', 'a0::2')"), "m")
    with pytest.raises(corpus.BadCorpus):
        artifacts.load_corpus(spark, path, plan, "m", ["a1", "nowhere"])
    with pytest.raises(corpus.BadCorpus):
        artifacts.load_corpus(spark, path, plan, "m", [])
    corpus.write_vectors(vectors.withColumn("revision", F.lit("other")).withColumn("aoi", F.lit("a2")), path)
    with pytest.raises(corpus.BadCorpus, match="more than one"):
        artifacts.load_corpus(spark, path, plan, "m")


def test_extents_weigh_areas_by_tiles(spark):
    rows = [("a", 112, "s1", 0.1)] * 3 + [("a", 112, "s2", 0.2)] + [("b", 112, "s3", 0.1)] * 4 + [("a", 224, "s1", 0.1), ("b", 224, "s3", 0.1)]
    got = {r.scale: (r.extent_m, r.areas, r.differ) for r in artifacts.ground_extents(spark.createDataFrame(rows, "aoi string, scale int, source string, gsd_m double")).collect()}
    assert got == {112: (pytest.approx((0.15 * 112 * 4 + 0.1 * 112 * 4) / 8), 2, True), 224: (pytest.approx(22.4), 2, False)}


def test_resuming(spark, vectors):
    listed = vectors.select("tile_id").limit(50)
    assert artifacts.resumed(listed, vectors).count() == 50
    with pytest.raises(artifacts.MissingTiles, match="gone"):
        artifacts.resumed(listed.unionByName(spark.createDataFrame([("gone",)], "tile_id string")), vectors)


@pytest.mark.parametrize("dim", [None, 8, 4])
def test_export_round_trip(spark, vectors, tmp_path, dim):
    path = f"{tmp_path}/e"
    artifacts.build_export(vectors, path, str(tmp_path), dim)
    codes, basis, about = artifacts.load_export(spark, path)
    assert (about["tiles"], about["dim"], about["export_dim"]) == (120, 8, dim or 8) and (basis is None) == (dim is None)
    rows = {r.scale: (r.queries, r.mean_overlap) for r in artifacts.measured_overlap(vectors, path, asked(spark)).collect()}
    assert rows[None][1] == pytest.approx((rows[112][1] + rows[224][1]) / 2, abs=1e-6) and rows[112][0] == 6
    assert rows[None][1] > (0.9 if dim != 4 else 0.3)


def test_export_that_is_wrong(spark, vectors, tmp_path):
    path = f"{tmp_path}/e"
    artifacts.build_export(vectors, path, str(tmp_path), 4)
    with pytest.raises(artifacts.BadExport, match="stale"):
        artifacts.measured_overlap(vectors.filter("tile_id <> 'a0::0'"), path, asked(spark))
    spark.read.parquet(f"{path}/codes").limit(7).write.mode("append").parquet(f"{path}/codes")
    with pytest.raises(artifacts.BadExport, match="127 rows"):
        artifacts.load_export(spark, path)
    artifacts.build_export(vectors, path, str(tmp_path), 4)
    spark.read.parquet(f"{path}/basis").filter("at < 3").write.mode("overwrite").parquet(f"{path}/basis2")
    spark.read.parquet(f"{path}/basis2").write.mode("overwrite").parquet(f"{path}/basis")
    with pytest.raises(artifacts.BadExport, match="basis"):
        artifacts.load_export(spark, path)
    with pytest.raises(ValueError):
        artifacts.build_export(vectors, "/elsewhere/e", str(tmp_path))


def test_backgrounds_of_models_stay_apart(spark, vectors, tmp_path):
    path = f"{tmp_path}/b"
    artifacts.build_background({"m": vectors, "half": vectors.withColumn("embedding", F.transform("embedding", lambda x: x / 2))}, asked(spark), path, str(tmp_path))
    whole, half = (artifacts.load_background(spark, path, m).agg(F.sum("top1")).collect()[0][0] for m in ("m", "half"))
    assert half == pytest.approx(whole / 2, abs=1e-4) and artifacts.load_background(spark, path, "m", ["a0"]).count() == 12
    for model, areas in (("none", None), ("m", ["a9"])):
        with pytest.raises(corpus.BadCorpus):
            artifacts.load_background(spark, path, model, areas)


def test_many_queries_meet_packed_vectors(spark, vectors, monkeypatch):
    ids = vectors.select(F.split("tile_id", "::")[1].cast("long").alias("vec_id"), "scale", "embedding")
    want = {tuple(r) for r in ranking.top(ranking.scored(ids, asked(spark, 40), ["scale", "vec_id"]), 3, ["query_id", "scale"]).select("query_id", "scale", "rank", "vec_id", "score").collect()}
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)  # queries in several blocks
    monkeypatch.setattr(ranking, "PACK", 10)
    got = ranking.top_by_matrix(ids, asked(spark, 40), 3).select("query_id", "scale", "rank", "vec_id", "score").collect()
    assert len(got) == len(want) == 40 * 2 * 3 and {tuple(r) for r in got} == want
    assert ranking.top_by_matrix(ids, asked(spark, 40).limit(0), 3).collect() == []


def test_places_of_utm_coordinates(spark):
    # the equator on a central meridian, and a corner of a degree cell: 3 E 0 N is 166021.443 m east in zone 31
    rows = [(500000.0, 0.0, 31, False), (166021.443, 0.0, 31, False), (500000.0, 10000000.0, 36, True), (448251.795, 5411932.678, 31, False)]
    df = spark.createDataFrame(rows, "e double, n double, z int, s boolean")
    lon, lat = g.utm_lonlat(F.col("e"), F.col("n"), F.col("z"), F.col("s"))
    got = [(r.lon, r.lat) for r in df.select(lon.alias("lon"), lat.alias("lat")).collect()]
    for (a, b), (c, d) in zip(got, [(3.0, 0.0), (0.0, 0.0), (33.0, 0.0), (2.2945, 48.8582)], strict=True):
        assert a == pytest.approx(c, abs=2e-4) and b == pytest.approx(d, abs=2e-4)


def test_ordered_plan(spark):
    scenes = spark.createDataFrame([(2, 500, 300, "b", "d"), (1, 300, 500, "a", "d")], "scene_id int, width int, height int, aoi string, acq_date string")
    rows = [(r.scene_id, r.scale, r.row_, r.col) for r in tiling.tile_plan(scenes, limit=9).collect()]
    assert rows[:4] == [(1, 448, 0, 0), (1, 448, 1, 0), (1, 224, 0, 0), (1, 224, 0, 1)] and len(rows) == 9
