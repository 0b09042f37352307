"""Queries that build something, load it again and report on what was loaded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions.vectors import normalised
from tilespark.session import shared_path
from tilespark.sources import artifacts, corpus
from tilespark.sources.views import oracle, table


def _vectors(spark, sf_dir):
    c = table(spark, sf_dir, "vec_corpus")
    ident = F.concat_ws("::", "aoi", F.col("vec_id").cast("string"))
    return c.select(F.lit("whole").alias("model_id"), F.lit("r1").alias("revision"), "aoi", ident.alias("tile_id"), "scale", "nodata_fraction", normalised(F.col("embedding")).cast("array<float>").alias("embedding"))


def _plan(spark, sf_dir):
    g = table(spark, sf_dir, "tile_grid")
    ident = F.concat_ws("::", "aoi", F.col("vec_id").cast("string"))
    source = F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string"))
    return g.select(ident.alias("tile_id"), "aoi", "scale", source.alias("source"), "acq_date", "min_lon", "min_lat", "max_lon", "max_lat", (F.lit(0.08) + (F.col("vec_id") % 3) / 100.0).alias("gsd_m"))


def located_corpus(spark, sf_dir):
    """Vectors written by model and area, read back for two areas, checked, and joined to their tiles."""
    path = shared_path(spark, "vectors")
    corpus.write_vectors(_vectors(spark, sf_dir), path)
    found = artifacts.load_corpus(spark, path, _plan(spark, sf_dir), "whole", ["aoi_0", "aoi_1"])
    return found.select("tile_id", "aoi", "scale", "source", "acq_date", F.round("min_lon", 9).alias("min_lon"), F.round("max_lat", 9).alias("max_lat"))


def combined_extents(spark, sf_dir):
    return artifacts.ground_extents(artifacts.located(_vectors(spark, sf_dir), _plan(spark, sf_dir)))


def export_overlap(spark, sf_dir):
    """Export of codes written, loaded, checked and measured: mean overlap per scale, and over scales."""
    raw = table(spark, sf_dir, "vec_corpus").select(F.concat_ws("::", "aoi", F.col("vec_id").cast("string")).alias("tile_id"), "embedding")
    v, path = _vectors(spark, sf_dir).drop("embedding").join(raw, "tile_id"), shared_path(spark, "export")
    artifacts.build_export(v, path, path.rsplit("/", 1)[0])
    return artifacts.measured_overlap(v, path, table(spark, sf_dir, "user_queries"))


def background_reload(spark, sf_dir):
    """Background scores of two models written and one of them loaded."""
    c, path = table(spark, sf_dir, "vec_corpus"), shared_path(spark, "background")
    half = c.withColumn("embedding", F.transform(F.col("embedding"), lambda x: x * 0.5))
    artifacts.build_background({"whole": c, "half": half}, table(spark, sf_dir, "bg_queries"), path, path.rsplit("/", 1)[0])
    return artifacts.load_background(spark, path, "whole")


QUERIES = {f.__name__: f for f in (located_corpus, combined_extents, export_overlap, background_reload)}

_TOP = "SELECT query_id, scale, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scale ORDER BY score DESC, vec_id) AS k FROM {0}) r WHERE k <= 10"
_IDENT = "aoi || '::' || vec_id"
ORACLE = {
    name: oracle(sql)
    for name, sql in {
        "located_corpus": f"SELECT {_IDENT} AS tile_id, aoi, scale, 's' || vec_id % 3 AS source, acq_date, round(min_lon, 9) AS min_lon, round(max_lat, 9) AS max_lat FROM {{tile_grid}} WHERE aoi IN ('aoi_0', 'aoi_1')",
        "combined_extents": """WITH s AS (SELECT aoi, scale, vec_id % 3 AS source, 0.08e0 + vec_id % 3 / 100e0 AS gsd, count(*) AS n FROM {tile_grid} GROUP BY ALL),
          a AS (SELECT aoi, scale, avg(gsd) * scale AS e, sum(n) AS n FROM s GROUP BY aoi, scale)
          SELECT scale, round(sum(e * n) / sum(n), 6) AS extent_m, count(*) AS areas, count(DISTINCT round(e, 6)) > 1 AS differ FROM a GROUP BY scale""",
        "export_overlap": f"""WITH cs AS (SELECT vec_id, scale, CAST(embedding AS DOUBLE[]) AS e, (SELECT max(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)))) / 127 FROM {{vec_corpus}}) AS s FROM {{vec_corpus}}),
          a AS (SELECT query_id, scale, vec_id, round(list_dot_product(e, CAST(q.embedding AS DOUBLE[])), 6) AS score FROM cs, {{user_queries}} q),
          b AS (SELECT query_id, scale, vec_id, round(list_dot_product(list_transform(e, lambda x: greatest(-127, least(127, round_even(x / s, 0))) * s), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM cs, {{user_queries}} q),
          ta AS ({_TOP.format("a")}), tb AS ({_TOP.format("b")}),
          o AS (SELECT ta.query_id, ta.scale, round(count(tb.vec_id) / CAST(count(*) AS DOUBLE), 6) AS overlap FROM ta LEFT JOIN tb ON ta.query_id = tb.query_id AND ta.scale = tb.scale AND ta.vec_id = tb.vec_id GROUP BY 1, 2),
          p AS (SELECT scale, count(*) AS queries, avg(overlap) AS m FROM o GROUP BY scale)
          SELECT scale, queries, round(m, 6) AS mean_overlap FROM p UNION ALL SELECT NULL, max(queries), round(avg(m), 6) FROM p""",
        "background_reload": """SELECT query_id, aoi, scale, max(round(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)) AS top1
          FROM {vec_corpus} c, (SELECT query_id, embedding FROM {bg_queries}) q GROUP BY 1, 2, 3""",
    }.items()
}
