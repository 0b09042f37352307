"""Every registered query of the library's own families against its SQL, and the entry module with and without the optional part."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.operators import export, ranking
from tilespark.plans import artifacts, exports, layout, search, tracking
from tilespark.sources import corpus
from tilespark.streaming import windows

from .conftest import ROOT, SMALL

FAMILIES = (search, layout, tracking, exports, artifacts, windows)
QUERIES = {n: f for m in FAMILIES for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in FAMILIES for n, s in m.ORACLE.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if name not in ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    r = con.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry_without_the_optional_part(tmp_path):
    code = f"""
import sys, importlib.abc
sys.path.insert(0, {ROOT!r})
class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tilespark.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
q = e.queries()
assert "topk_per_scale" in q and not any(n.startswith("op") and n[2].isdigit() for n in q) and "pipeline" not in q
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_top_k_is_an_exact_ranking(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = x[3]
    c = spark.createDataFrame([(i, 112 * (1 + i % 2), [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, scale int, embedding array<double>")
    q = spark.createDataFrame([(0, [float(v) for v in x[3]])], "query_id long, embedding array<double>")
    want = []
    for s in (112, 224):
        own = [i for i in range(200) if 112 * (1 + i % 2) == s]
        score = {i: round(float(x[i] @ x[3]), 6) for i in own}
        want += [(s, k + 1, i) for k, i in enumerate(sorted(own, key=lambda i: (-score[i], i))[:10])]
    got = ranking.top(ranking.scored(c, q, ["scale", "vec_id"]), 10, ["query_id", "scale"])
    assert sorted((r["scale"], r["rank"], r.vec_id) for r in got.collect()) == want
    assert sorted((r["scale"], r["rank"], r.vec_id) for r in ranking.top_by_matrix(c, q, 10).collect()) == want


def test_confidence_does_not_change_under_scaling(spark):
    rng = np.random.default_rng(2)
    bg = rng.normal(0.2, 0.02, 30)
    band = lambda a, b: ranking.confidence(
        spark.createDataFrame([(1, 112, float(a * 0.21 + b)), (1, 224, 0.1)], "query_id long, scale int, top1 double"), spark.createDataFrame([(112, float(a * v + b)) for v in bg], "scale int, top1 double")
    ).collect()
    first, second = ({r["scale"]: (r.percentile, r.band) for r in band(*p)} for p in ((1, 0), (3, 0.5)))
    assert first == second and first[224] == (None, "unknown")
    assert first[112][0] == pytest.approx(100 * (bg <= 0.21).mean())


def test_basis_is_not_centred(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 12)) + 2
    c = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    rows = export.basis(c, 4)
    assert np.allclose(rows @ rows.T, np.eye(4), atol=1e-9)
    mean = x.mean(0) / np.linalg.norm(x.mean(0))
    assert abs(rows[0] @ mean) > 0.99
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    assert np.allclose(np.abs((rows * vectors[:, ::-1].T[:4]).sum(1)), 1, atol=1e-8)


def test_codes_are_half_even_and_bounded(spark):
    c = spark.createDataFrame([(1, [127.0, 0.5, 1.5, -2.5]), (2, [0.0, -127.0, 3.4, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in export.coded(c).collect()}
    assert got[1].scale_ == 1.0 and list(got[1].codes) == [127, 0, 2, -2] and list(got[2].codes) == [0, -127, 3, 0]
    zero = export.coded(spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()[0]
    assert zero.scale_ == 1.0 and list(zero.codes) == [0, 0]


def vectors(spark, *rows):
    return spark.createDataFrame([("m", "r1", a, t, s, 0.0, v) for a, t, s, v in rows], corpus.VECTORS)


def test_index_round_trip_and_checks(spark, tmp_path):
    good = vectors(spark, ("x", "t1", 112, [1.0, 0.0]), ("y", "t2", 112, [0.6, 0.8]))
    path = f"file://{tmp_path}/index"
    corpus.write_vectors(good, path)
    assert corpus.read_vectors(spark, path, "m", ["x"]).count() == 1
    with pytest.raises(corpus.BadCorpus, match="no index"):
        corpus.read_vectors(spark, path, "m", ["z"])
    plan = corpus.read_vectors(spark, path, "m", ["y"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "aoi" in plan.split("PartitionFilters: [")[1][:200]
    for bad, what in (([float("nan"), 1.0], "not_finite"), ([float("inf"), 1.0], "not_finite"), ([1.0, 1.0], "norm")):
        with pytest.raises(corpus.BadCorpus, match=what):
            corpus.checked(vectors(spark, ("x", "t1", 112, bad)))
    corpus.checked(vectors(spark, ("x", "t1", 112, [1.005, 0.0])))
    with pytest.raises(corpus.BadCorpus, match="scales"):
        corpus.checked(vectors(spark, ("x", "t1", 112, [1.0, 0.0]), ("y", "t2", 224, [1.0, 0.0])))
    with pytest.raises(corpus.BadCorpus, match="model"):
        corpus.checked(good.unionByName(good.withColumn("revision", F.lit("r2"))))


def test_resume_leaves_nothing_out(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "tile_id string")
    assert [r.tile_id for r in corpus.todo(ids("a", "b", "c"), ids("a"), ids("c")).collect()] == ["b"]


def test_clip_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"meta": {"clip_id": "k", "fps": 10}, "tracks": [{"id": 1, "boxes": {"3": [0, 0, 1, 1], "12": [1, 1, 2, 2]}}, {"id": 2, "label": "car", "ignore": true, "acquired_frame": 7, "boxes": {"9": [0, 0, 1, 1]}}]}')
    rows = {(r.track_id, r.frame): r for r in corpus.read_clips(spark, f"file://{tmp_path}/c.json", "gt").collect()}
    assert rows.keys() == {(1, 3), (1, 12), (2, 9)} and rows[1, 12].acquired_frame == 3 and rows[1, 3].label == "" and rows[2, 9].ignore and rows[2, 9].acquired_frame == 7


def test_stream_of_acquisitions(spark, tmp_path):
    seen = [(1, f, o) for o, first in ((5, 2), (6, 10), (7, 11)) for f in range(first, 30)]
    spark.createDataFrame(seen, "clip_id int, frame int, object_id int").coalesce(1).write.parquet(f"{tmp_path}/seen")
    stream = spark.readStream.schema("clip_id int, frame int, object_id int").parquet(f"{tmp_path}/seen")
    got = windows.run_to_end(windows.acquisitions(stream, 5), "append", "acquired").collect()
    assert sorted((r.object_id, r.acquired_frame, r.track_id) for r in got) == [(5, 5, 1), (6, 10, 2), (7, 15, 3)]


def test_streams_lose_nothing_in_any_order_of_files(spark, tmp_path):
    n = 24
    (tmp_path / "events.parquet").mkdir()
    for i in range(n):  # the newest event in the oldest file, then back and forth
        day = n - i if i % 3 else i
        df = spark.sql(f"SELECT CAST({i} AS LONG) AS event_id, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval({2 * day}, {i % 3}) AS ts, CAST(1 AS LONG) AS user_id, 'a' AS event_type, 1.0D AS value, '' AS props")
        df.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet" / f"{i:02}.parquet")
        os.utime(tmp_path / "events.parquet" / f"{i:02}.parquet", (1_700_000_000 + 60 * i,) * 2)
    assert sum(r.n for r in windows.stream_sessions(spark, str(tmp_path)).collect()) == n
    assert sum(r.n for r in windows.stream_windows(spark, str(tmp_path)).collect()) == n
