"""Numbers without one task, packed columns, windows from strips, bake-offs and observed builds, against plain Python."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.operators import bakeoff, builds, inventory, packing
from tilespark.sources import corpus, rasters


def test_numbers_are_places(spark):
    values = random.Random(1).sample(range(100_000), 3_000)
    got = packing.numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), [F.col("v")]).collect()
    assert sorted((r.number, r.v) for r in got) == list(enumerate(sorted(values)))
    assert packing.numbered(spark.createDataFrame([], "v int"), [F.col("v")]).collect() == []


def test_sources_in_the_order_of_their_first_tile(spark):
    rows = [(k, f"s{(k * 7) % 11 if k % 3 else (k * 5) % 13}") for k in range(500)]
    want = {s: i for i, s in enumerate(dict.fromkeys(s for _, s in rows))}
    got = packing.first_seen(spark.createDataFrame(rows, "at int, source string").repartition(5), "source", "at")
    assert {r.source: r.src for r in got.collect()} == want


TILES = "scale int, vec_id int, codes array<tinyint>, src long, px_x int, px_y int, min_lon float, min_lat float, max_lon float, max_lat float"


def some_tiles(n=900):
    rng = random.Random(2)
    return [(rng.choice([112, 224, 224, 224]), k, [rng.randrange(-127, 128) for _ in range(6)], k % 300, k * 3, -k, *(float(np.float32(rng.random())) for _ in range(4))) for k in rng.sample(range(10_000), n)]


@pytest.mark.parametrize("piece", [1, 64, packing.PIECE])
def test_columns_come_back(spark, piece):
    rows = some_tiles(900 if piece > 1 else 40)
    tiles = packing.in_scale(spark.createDataFrame(rows, TILES).repartition(3), "vec_id")
    packed = packing.packed_columns(tiles, piece)
    sizes = [r.n for r in packed.collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= piece
    got = {(r["scale"], r["at"]): tuple(r)[2:] for r in packing.unpacked_columns(packed, piece).collect()}
    want = {}
    for scale in (112, 224):
        for k, r in enumerate(sorted((r for r in rows if r[0] == scale), key=lambda r: r[1])):
            want[scale, k] = r[2:]
    assert got == want


def test_columns_that_do_not_fit_are_refused(spark):
    row = (112, 1, [1], 1 << 33, 0, 0, 0.0, 0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="src does not fit"):
        packing.packed_columns(spark.createDataFrame([(*row, 0)], TILES + ", at long")).collect()


def test_windows_are_the_padded_pixels(spark):
    rng = random.Random(4)
    sizes = {1: (10, 7), 2: (3, 12), 3: (8, 8)}
    value = {(i, x, y): rng.randrange(256) for i, (w, h) in sizes.items() for x in range(w) for y in range(h)}
    strips = [(i, y, 1, bytes(value[i, x, y] for x in range(w))) for i, (w, h) in sizes.items() for y in range(h)]
    tiles = [(f"{i}/{x}/{y}/{s}", i, s, x, y) for i, (w, h) in sizes.items() for s in (4, 5) for x in range(0, w, s) for y in range(0, h, s)]
    kinds = "tile_id string, raster_id int, scale int, px_x int, px_y int"
    got = {r.tile_id: bytes(r.data) for r in packing.tile_bytes(spark.createDataFrame(strips, "raster_id int, y int, pixel_bytes int, data binary"), spark.createDataFrame(tiles, kinds)).collect()}
    pixels = spark.createDataFrame([(*k, v) for k, v in value.items()], "scene_id int, x int, y int, value int")
    plain = rasters.padded_windows(pixels, spark.createDataFrame(tiles, kinds).withColumnRenamed("raster_id", "scene_id")).collect()
    want = {t[0]: bytearray(t[2] ** 2) for t in tiles}
    scale = {t[0]: t[2] for t in tiles}
    for r in plain:
        want[r.tile_id][r.y * scale[r.tile_id] + r.x] = r.value
    assert got == {k: bytes(v) for k, v in want.items()}
    away = packing.tile_bytes(spark.createDataFrame(strips, "raster_id int, y int, pixel_bytes int, data binary"), spark.createDataFrame([("t", 1, 4, 20, 0), ("u", 9, 4, 0, 0)], kinds)).collect()
    assert {r.tile_id: bytes(r.data) for r in away} == {"t": bytes(16), "u": bytes(16)}


def test_crops_divide_their_square(spark):
    got = {(r["scale"], r.local_x, r.local_y, r.scene_x, r.scene_y) for r in bakeoff.calibration_crops(spark, 448, [112, 224, 448], 10, 20).collect()}
    assert got == {(s, x, y, x + 10, y + 20) for s in (112, 224, 448) for x in range(0, 448, s) for y in range(0, 448, s)}
    with pytest.raises(ValueError, match="100 does not divide"):
        bakeoff.calibration_crops(spark, 448, [112, 100])


def test_bake_off_against_sorting(spark):
    rng = np.random.default_rng(5)
    crops, queries = [], []
    for c, d in (("a", 8), ("b", 5)):
        crops += [(c, int(s), k, rng.normal(size=d).round(1).tolist()) for k, s in enumerate(rng.choice([1, 2, 3], 200))]
        crops.append((c, 1, 777, crops[-1][3]))
        queries += [(c, q, rng.normal(size=d).round(1).tolist()) for q in range(3)]
    queries.append(("c", 0, [1.0]))
    tops, spread = bakeoff.bake_off(spark.createDataFrame(crops, "candidate string, scale int, vec_id long, embedding array<double>").repartition(4), spark.createDataFrame(queries, "candidate string, query_id int, embedding array<double>"), 4)
    want, summary = set(), {}
    for c, q, v in queries[:-1]:
        scores = [(s, k, sum(a * b for a, b in zip(v, x, strict=True))) for n, s, k, x in crops if n == c]
        summary[c, q] = (len(scores), *(round(f(s[2] for s in scores), 3) for f in (min, max)), round(sum(s[2] for s in scores) / len(scores), 3))
        for scope in ("all", "1", "2", "3"):
            own = sorted((-round(s[2], 6), s[1]) for s in scores if scope in ("all", str(s[0])))[:4]
            want |= {(c, q, scope, r + 1, k) for r, (_, k) in enumerate(own)}
    assert {tuple(r)[:5] for r in tops.collect()} == want
    assert {(r.candidate, r.query_id): (r.n, round(r.score_min, 3), round(r.score_max, 3), round(r.score_mean, 3)) for r in spread.collect()}.keys() == summary.keys()
    for r in spread.collect():
        assert (r.n, r.score_min, r.score_max, r.score_mean) == pytest.approx(summary[r.candidate, r.query_id], abs=1e-3)
    many = spark.range(bakeoff.MOST_QUERIES + 1).select(F.lit("a").alias("candidate"), F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError, match="more than"):
        bakeoff.bake_off(spark.createDataFrame(crops, "candidate string, scale int, vec_id long, embedding array<double>"), many)


def test_a_build_goes_on_where_it_stopped(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    tiles = [(f"t{k}", 1.0 if k % 5 == 0 else 0.25) for k in range(50)]
    df = lambda rows: spark.createDataFrame(rows, "tile_id string, nodata_fraction double").repartition(3)
    embed = lambda rows, size: rows.select("tile_id", F.array(F.lit(float(size)), F.length("tile_id").cast("double")).alias("embedding"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", builds.OtherBatchSize)
        one = builds.build(df(tiles[:30]), embed, root, "m", "r1", 32)
        assert (one["planned"], one["embedded_this_run"], one["embedded_total"], one["skipped_this_run"], one["skipped_total"]) == (30, 24, 24, 6, 6) and one["tiles_per_sec"] > 0
        again = builds.build(df(tiles[:30]), embed, root, "m", "r1", 32)
        assert (again["embedded_this_run"], again["embedded_total"], again["skipped_this_run"], again["skipped_total"]) == (0, 24, 0, 6)
    with pytest.warns(builds.OtherBatchSize, match="begun with batches of 32, this run has 64"):
        rest = builds.build(df(tiles), embed, root, "m", "r1", 64)
    assert (rest["planned"], rest["embedded_this_run"], rest["embedded_total"], rest["skipped_this_run"], rest["skipped_total"], rest["batch_size"]) == (50, 16, 40, 4, 10, 32)
    vectors = spark.read.parquet(f"{root}/vectors")
    assert vectors.count() == vectors.select("tile_id").distinct().count() == 40 and builds.reports(spark, root).count() == 3
    with pytest.raises(corpus.BadCorpus, match="is of m r1, not of m r2"):
        builds.build(df(tiles), embed, root, "m", "r2", 32)


def test_a_tree_has_one_digest(spark):
    rows = [(f"a/{k}", k * 3) for k in range(600)]
    files = spark.createDataFrame(rows, "path string, size int")
    digest = lambda df, most: df.transform(lambda d: inventory.tree_digest(d, "path", ["size"], most)).collect()[0]
    for most in (4096, 1):  # groups of two digits, and of more, which are digested again
        one = digest(files, most)
        assert one.files == 600 and digest(files.repartition(5, "size"), most) == one == digest(files.orderBy(F.desc("path")), most)
        assert digest(spark.createDataFrame([*rows[:-1], ("a/599", 1)], "path string, size int"), most).digest != one.digest
    assert digest(files, 4096).digest != digest(files, 1).digest


def test_prefixes_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a/1",), ("ab/2",), ("b/3",)], "path string").write.parquet(f"{tmp_path}/files")
    found = inventory.under(spark.read.parquet(f"{tmp_path}/files"), "path", ["a/", "b"])
    assert {r.path for r in found.collect()} == {"a/1", "b/3"} and inventory.under(found, "path", []).count() == 0
    assert "StringStartsWith(path,a/)" in found._jdf.queryExecution().executedPlan().toString()
