"""Queries over the vector corpus: ranking per scale, filters, confidence, comparison of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.geometry import intersects, tile_id
from tilespark.functions.text import signed_score
from tilespark.functions.vectors import normalised
from tilespark.operators import ranking
from tilespark.sources.views import oracle, table

BBOX = (34.005, 30.95, 34.03, 30.995)
DATE = "2025-06-06"
HIT = ["query_id", "scale", "rank", "vec_id", "score"]

SCORED = """scored AS (
  SELECT q.query_id, c.scale, c.aoi, c.acq_date, c.vec_id,
    round(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM {vec_corpus} c, {user_queries} q)"""
RANKED = """
SELECT query_id, scale, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, scale ORDER BY score DESC, vec_id) AS rank FROM scored %s) r WHERE rank <= 10"""


def _scored(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None, carry=("scale", "vec_id")) -> DataFrame:
    return ranking.scored(corpus if corpus is not None else table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "user_queries"), list(carry))


def topk_per_scale(spark, sf_dir):
    return ranking.top(_scored(spark, sf_dir), 10, ["query_id", "scale"]).select(HIT)


def topk_by_matrix(spark, sf_dir):
    return ranking.top_by_matrix(table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "user_queries"), 10).select(HIT)


def topk_bbox(spark, sf_dir):
    grid = table(spark, sf_dir, "tile_grid")
    inside = grid.filter(intersects(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"), BBOX)).select("vec_id")
    corpus = table(spark, sf_dir, "vec_corpus").join(inside, "vec_id", "left_semi")
    return ranking.top(_scored(spark, sf_dir, corpus), 10, ["query_id", "scale"]).select(HIT)


def topk_date(spark, sf_dir):
    return ranking.top(_scored(spark, sf_dir, table(spark, sf_dir, "vec_corpus").filter(F.col("acq_date") == DATE)), 10, ["query_id", "scale"]).select(HIT)


def topk_aoi(spark, sf_dir):
    return ranking.top(_scored(spark, sf_dir, table(spark, sf_dir, "vec_corpus").filter("aoi IN ('aoi_1', 'aoi_2')")), 10, ["query_id", "scale"]).select(HIT)


def topk_global(spark, sf_dir):
    return ranking.top(_scored(spark, sf_dir), 10, ["query_id"]).select("query_id", "rank", "vec_id", "score")


def model_compare(spark, sf_dir):
    """Two models side by side: the whole vector and its first half, each ranked by itself; a third has no index and is not available."""
    corpus, queries = table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "user_queries")
    first = lambda d: d.withColumn("embedding", normalised(F.slice("embedding", 1, 32)))
    one = lambda c, q, name: ranking.top(ranking.scored(c, q, ["scale", "vec_id"]), 3, ["query_id", "scale"]).withColumn("model_id", F.lit(name))
    found = one(corpus, queries, "whole").unionByName(one(first(corpus), first(queries), "half"))
    models = spark.createDataFrame([("whole",), ("half",), ("absent",)], "model_id string")
    return models.join(found, "model_id", "left").select("model_id", F.col("rank").isNotNull().alias("available"), *HIT)


def scale_stats(spark, sf_dir):
    return ranking.scale_summary(_scored(spark, sf_dir))


def background_top1(spark, sf_dir):
    rows = ranking.scored(table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "bg_queries"), ["aoi", "scale"])
    return rows.groupBy("query_id", "aoi", "scale").agg(F.max("score").alias("top1"))


def confidence_band(spark, sf_dir):
    rows = ranking.scored(table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "bg_queries"), ["scale"])
    background = rows.groupBy("query_id", "scale").agg(F.max("score").alias("top1"))
    return ranking.confidence(ranking.scale_summary(_scored(spark, sf_dir)).select("query_id", "scale", "top1"), background)


def weak_match_gap(spark, sf_dir):
    return ranking.isolation(_scored(spark, sf_dir))


def results_enriched(spark, sf_dir):
    """Hits joined to their tiles after ranking: identifier, centre, printed score."""
    hits = ranking.top(_scored(spark, sf_dir), 5, ["query_id", "scale"]).select(HIT)
    grid = table(spark, sf_dir, "tile_grid").drop("scale")
    joined = hits.join(grid, "vec_id")
    return joined.select(
        "query_id", "rank", "vec_id", "scale",
        tile_id(F.col("aoi"), F.lit("scene.tif"), F.col("acq_date"), F.col("scale"), F.col("col"), F.col("row_")).alias("tile_id"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"), signed_score(F.col("score")).alias("shown"),
    )


def ground_extent_weighted(spark, sf_dir):
    """Mean ground extent of a tile per scale: per area first, then weighted by the areas' tile counts."""
    rows = table(spark, sf_dir, "vec_corpus").withColumn("gsd", F.lit(0.08) + F.col("label") / 100.0)
    per_area = rows.groupBy("aoi", "scale").agg((F.avg("gsd") * F.first("scale")).alias("extent"), F.count(F.lit(1)).alias("n"))
    return per_area.groupBy("scale").agg(F.round(F.sum(F.col("extent") * F.col("n")) / F.sum("n"), 6).alias("extent_m"), F.count(F.lit(1)).alias("areas"))


def ground_extent_note(spark, sf_dir):
    """Spread of the areas' extents per scale, in percent of the smallest."""
    rows = table(spark, sf_dir, "vec_corpus").withColumn("gsd", F.lit(0.08) + F.col("label") / 100.0)
    per_area = rows.groupBy("aoi", "scale").agg((F.avg("gsd") * F.first("scale")).alias("extent"))
    return per_area.groupBy("scale").agg(
        F.round(F.min("extent"), 6).alias("low"), F.round(F.max("extent"), 6).alias("high"), F.countDistinct(F.round("extent", 2)).alias("different"),
        F.round(F.lit(100.0) * (F.max("extent") - F.min("extent")) / F.min("extent"), 4).alias("percent"),
    )


def available_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "vec_corpus").filter("acq_date <> 'unknown'").select("aoi", "acq_date").distinct()
    both = rows.unionByName(rows.select(F.lit("all").alias("aoi"), "acq_date")).distinct()
    return both.groupBy("aoi").agg(F.array_join(F.array_sort(F.collect_set("acq_date")), ",").alias("dates"))


def indexed_areas(spark, sf_dir):
    return table(spark, sf_dir, "vec_corpus").groupBy("aoi").agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("scale").alias("scales"))


QUERIES = {
    f.__name__: f
    for f in (topk_per_scale, topk_by_matrix, topk_bbox, topk_date, topk_aoi, topk_global, model_compare, scale_stats, background_top1, confidence_band, weak_match_gap, results_enriched, ground_extent_weighted, ground_extent_note, available_dates, indexed_areas)
}

_BG = """bg AS (
  SELECT q.query_id, c.aoi, c.scale, max(round(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)) AS top1
  FROM {vec_corpus} c, {bg_queries} q GROUP BY 1, 2, 3)"""
_HALF = "list_transform(CAST(%s.embedding AS DOUBLE[])[1:32], lambda x: x / sqrt(list_dot_product(CAST(%s.embedding AS DOUBLE[])[1:32], CAST(%s.embedding AS DOUBLE[])[1:32])))"
_EXTENT = "per_area AS (SELECT aoi, scale, avg(CAST(0.08 AS DOUBLE) + label / CAST(100 AS DOUBLE)) * scale AS extent, count(*) AS n FROM {vec_corpus} GROUP BY aoi, scale)"

ORACLE = {
    name: oracle(sql)
    for name, sql in {
        "topk_per_scale": f"WITH {SCORED}{RANKED % ''}",
        "topk_by_matrix": f"WITH {SCORED}{RANKED % ''}",
        "topk_bbox": f"WITH {SCORED}" + RANKED % f"WHERE vec_id IN (SELECT vec_id FROM {{tile_grid}} WHERE min_lon <= {BBOX[2]} AND max_lon >= {BBOX[0]} AND min_lat <= {BBOX[3]} AND max_lat >= {BBOX[1]})",
        "topk_date": f"WITH {SCORED}" + RANKED % f"WHERE acq_date = '{DATE}'",
        "topk_aoi": f"WITH {SCORED}" + RANKED % "WHERE aoi IN ('aoi_1', 'aoi_2')",
        "topk_global": f"WITH {SCORED} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) r WHERE rank <= 10",
        "model_compare": f"""WITH {SCORED}, half AS (
            SELECT q.query_id, c.scale, c.vec_id, round(list_dot_product({_HALF % ("c", "c", "c")}, {_HALF % ("q", "q", "q")}), 6) AS score FROM {{vec_corpus}} c, {{user_queries}} q),
          found AS (SELECT 'whole' AS model_id, query_id, scale, vec_id, score FROM scored UNION ALL SELECT 'half', query_id, scale, vec_id, score FROM half),
          ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id, query_id, scale ORDER BY score DESC, vec_id) AS rank FROM found)
          SELECT model_id, true AS available, query_id, scale, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 3
          UNION ALL SELECT 'absent', false, NULL, NULL, NULL, NULL, NULL""",
        "scale_stats": f"WITH {SCORED} SELECT query_id, scale, count(*) AS corpus_size, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, max(score) AS top1 FROM scored GROUP BY query_id, scale",
        "background_top1": f"WITH {_BG} SELECT * FROM bg",
        "confidence_band": f"""WITH {SCORED}, {_BG}, best AS (SELECT query_id, scale, max(score) AS top1 FROM scored GROUP BY query_id, scale),
          b AS (SELECT query_id, scale, max(top1) AS b FROM bg GROUP BY query_id, scale),
          p AS (SELECT best.query_id, best.scale, best.top1, round(avg(CASE WHEN b <= best.top1 THEN 1 ELSE 0 END) * 100, 6) AS percentile FROM best JOIN b USING (scale) GROUP BY 1, 2, 3)
          SELECT *, CASE WHEN percentile < 33 THEN 'low' WHEN percentile < 67 THEN 'medium' ELSE 'high' END AS band FROM p""",
        "weak_match_gap": f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, scale ORDER BY score DESC, vec_id) AS k FROM scored),
          g AS (SELECT query_id, scale, count(*) AS n, max(score) AS top1, max(score) FILTER (k = 10) AS ref, stddev_pop(score) AS std FROM k GROUP BY query_id, scale)
          SELECT query_id, scale, CASE WHEN n > 10 AND std > 0 THEN round((top1 - ref) / std, 6) END AS gap, coalesce(n > 10 AND std > 0 AND (top1 - ref) / std > 0.75, false) AS weak FROM g""",
        "results_enriched": f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, scale ORDER BY score DESC, vec_id) AS rank FROM scored)
          SELECT r.query_id, CAST(r.rank AS INT) AS rank, r.vec_id, r.scale, concat_ws('::', g.aoi, 'scene.tif', g.acq_date, CAST(r.scale AS VARCHAR), printf('%05d', g.col), printf('%05d', g.row_)) AS tile_id,
            (min_lon + max_lon) / 2 AS lon, (min_lat + max_lat) / 2 AS lat, printf('%+.4f', r.score) AS shown FROM r JOIN {{tile_grid}} g ON r.vec_id = g.vec_id WHERE rank <= 5""",
        "ground_extent_weighted": f"WITH {_EXTENT} SELECT scale, round(sum(extent * n) / sum(n), 6) AS extent_m, count(*) AS areas FROM per_area GROUP BY scale",
        "ground_extent_note": f"""WITH {_EXTENT} SELECT scale, round(min(extent), 6) AS low, round(max(extent), 6) AS high, count(DISTINCT round(extent, 2)) AS different,
          round(100 * (max(extent) - min(extent)) / min(extent), 4) AS percent FROM per_area GROUP BY scale""",
        "available_dates": """WITH d AS (SELECT DISTINCT aoi, acq_date FROM {vec_corpus} WHERE acq_date <> 'unknown'), b AS (SELECT * FROM d UNION SELECT 'all', acq_date FROM d)
          SELECT aoi, string_agg(acq_date, ',' ORDER BY acq_date) AS dates FROM b GROUP BY aoi""",
        "indexed_areas": "SELECT aoi, count(*) AS vectors, count(DISTINCT scale) AS scales FROM {vec_corpus} GROUP BY aoi",
    }.items()
}
