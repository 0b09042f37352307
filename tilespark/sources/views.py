"""Views that bring the tables at hand into the shapes the operators work on.

Each is one SELECT that Spark and DuckDB both run; names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # vectors with scale, area and date; n is the place inside (area, scale)
    "vec_corpus": """
        SELECT vec_id, embedding, label, CASE label % 3 WHEN 0 THEN 448 WHEN 1 THEN 224 ELSE 112 END AS scale,
          concat('aoi_', CAST(label % 4 AS VARCHAR(10))) AS aoi,
          CASE WHEN label >= 5 THEN 'unknown' WHEN vec_id % 2 = 0 THEN '2022-10-29' ELSE '2025-06-06' END AS acq_date,
          CAST((vec_id % 11) / CAST(10 AS DOUBLE) AS DOUBLE) AS nodata_fraction,
          CAST(row_number() OVER (PARTITION BY label % 4, label % 3 ORDER BY vec_id) - 1 AS BIGINT) AS n
        FROM {embeddings}""",
    "tile_grid": """
        SELECT vec_id, scale, aoi, acq_date, nodata_fraction, CAST(n % 8 AS INT) AS col, CAST(floor(n / CAST(8 AS DOUBLE)) AS INT) AS row_,
          CAST(34 AS DOUBLE) + (n % 8) * scale / CAST(65536 AS DOUBLE) AS min_lon,
          CAST(34 AS DOUBLE) + ((n % 8) + 1) * scale / CAST(65536 AS DOUBLE) AS max_lon,
          CAST(31 AS DOUBLE) - (CAST(floor(n / CAST(8 AS DOUBLE)) AS BIGINT) + 1) * scale / CAST(65536 AS DOUBLE) AS min_lat,
          CAST(31 AS DOUBLE) - CAST(floor(n / CAST(8 AS DOUBLE)) AS BIGINT) * scale / CAST(65536 AS DOUBLE) AS max_lat
        FROM {vec_corpus}""",
    # the first vector of each label asks, the next three of each label are the background
    "user_queries": """
        SELECT vec_id AS query_id, embedding FROM (
          SELECT vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM {embeddings}) e WHERE k = 1""",
    "bg_queries": """
        SELECT vec_id AS query_id, embedding FROM (
          SELECT vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM {embeddings}) e WHERE k BETWEEN 2 AND 4""",
    "scenes": """
        SELECT p_partkey AS scene_id, CAST(500 + p_size * 37 AS INT) AS width, CAST(400 + CAST(p_partkey % 50 AS INT) * 31 AS INT) AS height,
          concat('area', CAST(p_partkey % 9 AS VARCHAR(10)), '/', p_brand, '/2024-0', CAST(1 + p_partkey % 9 AS VARCHAR(10)), '-11.tif') AS path,
          CASE p_partkey % 4 WHEN 0 THEN 'WGS 84 / Pseudo-Mercator' WHEN 1 THEN 'WGS 84 / UTM zone 36N' WHEN 2 THEN 'Transverse Mercator' ELSE NULL END AS crs,
          CAST(p_partkey % 60 AS DOUBLE) AS lat, CAST(5 + p_size AS DOUBLE) / 100 AS px
        FROM {part}""",
    "raster_bands": """
        SELECT l_suppkey AS raster_id, CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 3 END AS band_count,
          count(DISTINCT l_partkey % 101) AS d1, count(DISTINCT CAST(floor(l_extendedprice) AS BIGINT) % 90) AS d2,
          count(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey % 6 ELSE l_orderkey % 97 END) AS d3
        FROM {lineitem} GROUP BY l_suppkey""",
    # one box of ground truth per (clip, frame, lane); predictions are shifted, dropped or renamed; lanes never overlap
    "det_boxes": """
        SELECT clip_id, frame, gt_id, CAST(20 * frame AS DOUBLE) AS gx1, CAST(100 * gt_id AS DOUBLE) AS gy1,
          CASE WHEN k % 10 = 0 THEN NULL ELSE gt_id + CASE WHEN frame >= 30 AND gt_id = 3 THEN 10 ELSE 0 END END AS pred_id,
          CAST(CASE WHEN k % 7 = 0 THEN 8 ELSE k % 3 END AS DOUBLE) AS dx
        FROM (SELECT CAST(l_orderkey % 50 AS INT) AS clip_id, CAST(CAST(floor(l_orderkey / CAST(50 AS DOUBLE)) AS BIGINT) % 60 AS INT) AS frame,
                CAST(l_linenumber AS INT) AS gt_id, min(l_suppkey) AS k
              FROM {lineitem} GROUP BY 1, 2, 3) g""",
    # lane 7 is ignored; every twelfth frame has no ground truth: nobody labelled it; now and then clutter lies on lane 2, a track of its own each time
    "boxes": """
        SELECT clip_id, CASE k WHEN 0 THEN 'gt' ELSE 'pred' END AS side, CASE k WHEN 0 THEN gt_id WHEN 1 THEN CAST(pred_id AS INT) ELSE 1000 + frame END AS track_id,
          k = 0 AND gt_id = 7 AS ignore, frame, CASE WHEN k = 0 THEN 0 WHEN k = 2 THEN frame WHEN pred_id > 10 THEN 30 ELSE CAST(3 * (pred_id % 3) AS INT) END AS acquired_frame,
          gx1 + CASE k WHEN 0 THEN 0 WHEN 1 THEN dx ELSE 3 END AS x1, gy1 AS y1, gx1 + CASE k WHEN 0 THEN 0 WHEN 1 THEN dx ELSE 3 END + 10 AS x2, gy1 + 10 AS y2
        FROM {det_boxes} d CROSS JOIN (VALUES (0), (1), (2)) AS s(k)
        WHERE (k = 0 AND frame % 12 <> 11) OR (k = 1 AND pred_id IS NOT NULL) OR (k = 2 AND gt_id = 2 AND frame % 5 = 2)""",
    # lane 5 lies over lane 4: objects and predictions that overlap each other
    "crowd": """
        SELECT clip_id, side, track_id, ignore, frame, acquired_frame, x1 + CASE WHEN y1 = 500 THEN 3 ELSE 0 END AS x1, CASE WHEN y1 = 500 THEN 400 ELSE y1 END AS y1,
          x2 + CASE WHEN y1 = 500 THEN 3 ELSE 0 END AS x2, CASE WHEN y1 = 500 THEN 410 ELSE y2 END AS y2
        FROM {boxes} WHERE track_id < 1000 AND NOT ignore""",
    # clips as files name them: string ids, targets missing on two of them, two without any box, labelled frames declared for a third
    "clip_boxes": """
        SELECT concat('clip-', CAST(clip_id AS VARCHAR(10))) AS clip_id, side, track_id, ignore, frame, acquired_frame, x1, y1, x2, y2
        FROM {boxes} WHERE side = 'pred' OR clip_id < 48""",
    "clip_table": """
        SELECT concat('clip-', CAST(n_nationkey * 3 + k AS VARCHAR(10))) AS clip_id, CAST(n_nationkey % 3 * 5 AS DOUBLE) AS fps, (n_nationkey * 3 + k) % 3 = 0 OR n_nationkey * 3 + k >= 48 AS declared
        FROM {nation} CROSS JOIN (VALUES (0), (1), (2)) AS s(k) WHERE n_nationkey * 3 + k < 52""",
    "docs_content": "SELECT doc_id, n_chars, min(doc_id) OVER (PARTITION BY text) AS canonical_id FROM {documents}",
    "phrases": "SELECT DISTINCT p_name AS phrase, 'name' AS category FROM {part} UNION ALL SELECT DISTINCT p_type, 'type' FROM {part}",
    # per user: 30 points moving east at 10 px a frame, then 30 standing still, repeating
    "points": """
        SELECT user_id, frame, CAST(300 * CAST(floor(frame / CAST(60 AS DOUBLE)) AS BIGINT) + 10 * least(frame % 60, 30) AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y
        FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame FROM {events}) e""",
    "pixels": """
        SELECT CAST(l_suppkey AS INT) AS raster_id, CAST(l_orderkey % 64 AS INT) AS x, CAST(l_partkey % 64 AS INT) AS y, CAST(min(l_quantity) AS BIGINT) % 4 AS b1, CAST(min(l_linenumber) AS BIGINT) % 3 AS b2, min(l_partkey) % 2 AS b3
        FROM {lineitem} GROUP BY 1, 2, 3""",
}

NAMES = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir`` or a view over its tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, VIEWS[name])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in sorted(set(NAMES.findall(sql)))})


def _needed(sql: str, seen: list[str]) -> list[str]:
    for n in NAMES.findall(sql):
        if n in VIEWS and n not in seen:
            _needed(VIEWS[n], seen)
            seen.append(n)
    return seen


def oracle(sql: str) -> str:
    """The same text for DuckDB: views as common table expressions in front."""
    plain = lambda s: NAMES.sub(r"\1", s)
    views = ",\n".join(f"{n} AS MATERIALIZED ({plain(VIEWS[n])})" for n in _needed(sql, []))
    body = plain(sql).strip()
    if not views:
        return body
    return f"WITH {views},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {views}\n{body}"
