"""Queries about the compact export, phrases, checks and the incremental index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import text as t
from tilespark.functions.vectors import dot, norm
from tilespark.operators import bakeoff, export, inventory, packing, ranking
from tilespark.sources import corpus as src
from tilespark.sources.views import oracle, table


def int8_roundtrip(spark, sf_dir):
    """Codes of every vector under one scale, and the largest error they make."""
    c = export.coded(table(spark, sf_dir, "vec_corpus").select("vec_id", "embedding"))
    error = F.array_max(F.zip_with(F.col("embedding").cast("array<double>"), F.transform("codes", lambda x: x * F.col("scale_")), lambda a, b: F.abs(a - b)))
    return c.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.round("scale_", 9).alias("scale_"), F.round(error, 4).alias("error"), (error <= F.col("scale_") * 0.55 + 1e-9).alias("bounded"))


def topk_overlap(spark, sf_dir):
    """Share of the ten best that int8 codes find, per query and scale."""
    c, q = table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "user_queries")
    full = ranking.top(ranking.scored(c, q, ["scale", "vec_id"]), 10, ["query_id", "scale"])
    small = export.decoded(export.coded(c.select("vec_id", "scale", "embedding")))
    asked = export.decoded(export.coded(q))
    return export.overlap(full, ranking.top(ranking.scored(small, asked, ["scale", "vec_id"]), 10, ["query_id", "scale"]), 10)


def pca_overlap(spark, sf_dir):
    """The same after projection to half the dimensions of an uncentred basis, with a basis and codes of its own."""
    c, q = table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "user_queries")
    rows = export.basis(c, 32)
    full = ranking.top(ranking.scored(c, q, ["scale", "vec_id"]), 10, ["query_id", "scale"])
    small = export.decoded(export.coded(export.in_basis(c.select("vec_id", "scale", "embedding"), rows)))
    return export.overlap(full, ranking.top(ranking.scored(small, export.in_basis(q, rows), ["scale", "vec_id"]), 10, ["query_id", "scale"]), 10)


def export_background(spark, sf_dir):
    """Best score of each background query per scale, measured on the codes."""
    c, q = table(spark, sf_dir, "vec_corpus"), table(spark, sf_dir, "bg_queries")
    small = export.decoded(export.coded(c.select("vec_id", "scale", "embedding")))
    return ranking.scored(small, q, ["scale"]).groupBy("query_id", "scale").agg(F.max("score").alias("top1"))


def gram_matrix(spark, sf_dir):
    return export.gram(table(spark, sf_dir, "embeddings")).select("i", "j", F.round("v", 6).alias("v"))


def export_columns(spark, sf_dir):
    """The packed columns of an export, unpacked again: codes under one scale, sources by first occurrence, windows and boxes."""
    codes = export.coded(table(spark, sf_dir, "vec_corpus").select("vec_id", "embedding")).select("vec_id", "codes")
    g = table(spark, sf_dir, "tile_grid").withColumn("source", F.concat_ws("/", "aoi", "acq_date"))
    sources = packing.first_seen(g, "source", "vec_id")
    tiles = packing.in_scale(g.join(codes, "vec_id").join(sources, "source").withColumns({"px_x": F.col("col") * F.col("scale"), "px_y": F.col("row_") * F.col("scale")}), "vec_id")
    back = packing.unpacked_columns(packing.packed_columns(tiles, 100), 100)
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return back.select("scale", "at", "src", "px_x", "px_y", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], total.alias("code_sum"), F.get("codes", F.lit(0)).cast("int").alias("first_code"))


def query_codes(spark, sf_dir):
    """Codes of precomputed queries under a scale of their own."""
    q = export.coded(table(spark, sf_dir, "user_queries"))
    return q.select("query_id", F.round("scale_", 9).alias("scale_"), F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


def _candidates(spark, sf_dir):
    """Two candidates: the vectors as they are, and their first half."""
    both = lambda df: df.withColumn("candidate", F.lit("whole")).unionByName(df.withColumns({"candidate": F.lit("half"), "embedding": F.slice("embedding", 1, 32)}))
    return bakeoff.bake_off(both(table(spark, sf_dir, "vec_corpus").select("vec_id", "scale", "embedding")), both(table(spark, sf_dir, "user_queries")))


def bake_off_top(spark, sf_dir):
    return _candidates(spark, sf_dir)[0]


def bake_off_spread(spark, sf_dir):
    return _candidates(spark, sf_dir)[1]


def files_under(spark, sf_dir):
    """Scenes of two areas, by the beginning of their paths."""
    return inventory.under(table(spark, sf_dir, "scenes"), "path", ["area1/", "area5/Brand#2"]).select("scene_id", "path")


def labels_and_sides(spark, sf_dir):
    """Names that are shown and stored, and thumbnails within bounds."""
    p = table(spark, sf_dir, "part")
    dim = F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 16)
    return p.select("p_partkey", t.slug(F.col("p_type")).alias("slug"), t.model_label(F.col("p_brand"), dim).alias("label"), t.thumbnail_side(F.col("p_size") * 16).cast("int").alias("side"))


def opening_phrases(spark, sf_dir):
    """Nations as areas: each opens with the first type of the parts of its size, where that is no multiple of three."""
    types = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("phrase")).agg(F.min("p_partkey").alias("at"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("aoi"), "n_nationkey")
    sized = table(spark, sf_dir, "part").filter("p_size % 3 <> 0").groupBy("p_size").agg(F.min("p_type").alias("phrase"))
    chosen = nations.join(sized, F.col("n_nationkey") == F.col("p_size")).select("aoi", "phrase")
    return packing.opening_phrases(nations, types, chosen, types.agg(F.min("phrase")).first()[0])


def number_types(spark, sf_dir):
    """Suppliers as machines: every third has no accelerator."""
    s = table(spark, sf_dir, "supplier")
    device = F.when(F.col("s_suppkey") % 3 == 0, "cpu").otherwise("cuda")
    return s.select("s_suppkey", t.number_type(device, F.col("s_nationkey") % 10 + 1).alias("kind"))


def lexical_nearest(spark, sf_dir):
    """The ten phrases nearest in words, with a score above zero."""
    p = table(spark, sf_dir, "phrases").select("phrase", "category", t.lexical_similarity(F.lit("small red bolt"), F.col("phrase")).alias("score"))
    return p.filter("score > 0").orderBy(F.desc("score"), "phrase").limit(10)


def phrase_filter(spark, sf_dir):
    return table(spark, sf_dir, "phrases").filter(F.contains(F.lower("phrase"), F.lit("bolt"))).select("phrase", "category")


def phrase_categories(spark, sf_dir):
    return table(spark, sf_dir, "phrases").groupBy("category").agg(F.count(F.lit(1)).alias("phrases"), F.min("phrase").alias("first"))


def parse_boxes(spark, sf_dir):
    """Boxes written as decimals of the frame; those of two pixels or less on a side are dropped."""
    p = table(spark, sf_dir, "part")
    n = lambda c, w: F.lpad(c.cast("string"), w, "0")
    said = F.concat(F.lit("a car at ["), n(F.col("p_size"), 3), F.lit(", "), n(F.col("p_partkey") % 90, 2), F.lit(","), n(F.col("p_size") + F.col("p_partkey") % 40, 3), F.lit(" ,"), n(F.col("p_partkey") % 90 + 7, 2), F.lit("] and [1,2,3]"))
    each = p.select("p_partkey", F.explode(t.model_boxes(said)).alias("b"))
    at = lambda i, size: F.round(F.get("b", F.lit(i)) * float(size), 6)
    boxes = each.select("p_partkey", at(0, 1280).alias("x1"), at(1, 720).alias("y1"), at(2, 1280).alias("x2"), at(3, 720).alias("y2"))
    return boxes.filter("x2 - x1 > 2 AND y2 - y1 > 2")


def html_block(spark, sf_dir):
    p = src.tagged_block(table(spark, sf_dir, "pages"), "html", "script").withColumnRenamed("block", "script")
    return src.tagged_block(p, "html", "title").select("page_id", "script", F.col("block").alias("title"))


def query_cleanup(spark, sf_dir):
    """Typed queries trimmed and cut to 2000 characters, with a flag."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    q, cut = t.clean_query(F.col("text"))
    return d.select("doc_id", F.length(q).cast("long").alias("n"), cut.alias("truncated"), F.sha2(q.cast("binary"), 256).alias("digest"))


def resume_todo(spark, sf_dir):
    g = table(spark, sf_dir, "tile_grid").select(F.concat_ws("::", "aoi", F.col("vec_id").cast("string")).alias("tile_id"), "vec_id", "nodata_fraction")
    return src.todo(g.select("tile_id"), g.filter("vec_id % 3 = 0").select("tile_id"), g.filter("nodata_fraction >= 1.0").select("tile_id"))


def vector_checks(spark, sf_dir):
    """Vectors spoilt on purpose, found again: every seventh is stretched, every eleventh holds no number."""
    e = table(spark, sf_dir, "embeddings")
    spoilt = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") % 11 == 0) & (i == 3), F.lit(float("nan"))).otherwise(x * F.when(F.col("vec_id") % 7 == 0, 1.5).otherwise(1.0)))
    return src.problems(e.select(F.col("vec_id").alias("tile_id"), spoilt.alias("embedding")))


def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(norm(F.col("embedding"))), 5).alias("low"), F.round(F.max(norm(F.col("embedding"))), 5).alias("high"))


def mixed_model_check(spark, sf_dir):
    """Areas whose vectors come from more than one model or whose scales differ from the corpus's."""
    c = table(spark, sf_dir, "vec_corpus").withColumn("model", F.when(F.col("acq_date") == "unknown", "b").otherwise("a"))
    per = c.groupBy("aoi").agg(F.countDistinct("model").alias("models"), F.countDistinct("scale").alias("scales"))
    return per.select("aoi", "models", "scales", (F.col("models") > 1).alias("raises"))


def stale_export(spark, sf_dir):
    """Tiles that only the index or only the export has: an export of all but the newest tiles is stale."""
    g = table(spark, sf_dir, "tile_grid").select("vec_id", "acq_date")
    have, exported = g.select("vec_id"), g.filter("acq_date <> '2025-06-06'").select("vec_id")
    return have.exceptAll(exported).withColumn("only", F.lit("index")).unionByName(exported.exceptAll(have).withColumn("only", F.lit("export")))


def near_pairs_by_label(spark, sf_dir):
    """Mean cosine of each label's vectors to the label's first."""
    e = table(spark, sf_dir, "embeddings")
    lead = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead"))
    return e.join(lead, "label").groupBy("label").agg(F.round(F.avg(dot(F.col("embedding"), F.col("lead"))), 6).alias("mean_cosine"))


QUERIES = {
    f.__name__: f
    for f in (int8_roundtrip, topk_overlap, pca_overlap, export_background, export_columns, query_codes, bake_off_top, bake_off_spread, files_under, labels_and_sides, opening_phrases, number_types, gram_matrix, lexical_nearest, phrase_filter, phrase_categories, parse_boxes, html_block, query_cleanup, resume_todo, vector_checks, vector_norms, mixed_model_check, stale_export, near_pairs_by_label)
}

_V = "CAST({0}embedding AS DOUBLE[])"
_PEAK = "(SELECT max(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)))) / 127 FROM {0})"
_CODE = "list_transform(CAST({0}embedding AS DOUBLE[]), lambda x: greatest(-127, least(127, round_even(x / {1}, 0))))"
_SMALL = f"cs AS (SELECT vec_id, scale, embedding, {_PEAK.format('{vec_corpus}')} AS s FROM {{vec_corpus}}), small AS (SELECT vec_id, scale, list_transform({_CODE.format('', 's')}, lambda y: y * s) AS v FROM cs)"
_TOP = "SELECT query_id, scale, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scale ORDER BY score DESC, vec_id) AS k FROM {0}) r WHERE k <= 10"

ORACLE = {
    name: oracle(sql)
    for name, sql in {
        "int8_roundtrip": f"""WITH s AS (SELECT vec_id, embedding, {_PEAK.format("{vec_corpus}")} AS s FROM {{vec_corpus}}), c AS (SELECT *, {_CODE.format("", "s")} AS codes FROM s),
          e AS (SELECT *, list_max(list_transform(range(1, len(codes) + 1), lambda i: abs(CAST(embedding[i] AS DOUBLE) - codes[i] * s))) AS error FROM c)
          SELECT vec_id, CAST(list_sum(codes) AS BIGINT) AS code_sum, round(s, 9) AS scale_, round(error, 4) AS error, error <= s * 0.55 + 1e-9 AS bounded FROM e""",
        "topk_overlap": f"""WITH {_SMALL}, qs AS (SELECT query_id, embedding, {_PEAK.format("{user_queries}")} AS s FROM {{user_queries}}), sq AS (SELECT query_id, list_transform({_CODE.format("", "s")}, lambda y: y * s) AS v FROM qs),
          a AS (SELECT query_id, scale, vec_id, round(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM {{vec_corpus}} c, {{user_queries}} q), b AS (SELECT query_id, scale, vec_id, round(list_dot_product(small.v, sq.v), 6) AS score FROM small, sq),
          ta AS ({_TOP.format("a")}), tb AS ({_TOP.format("b")})
          SELECT ta.query_id, ta.scale, round(count(tb.vec_id) / CAST(least(count(*), 10) AS DOUBLE), 6) AS overlap FROM ta LEFT JOIN tb ON ta.query_id = tb.query_id AND ta.scale = tb.scale AND ta.vec_id = tb.vec_id GROUP BY 1, 2""",
        "export_background": f"WITH {_SMALL} SELECT query_id, scale, max(round(list_dot_product(v, CAST(q.embedding AS DOUBLE[])), 6)) AS top1 FROM small, {{bg_queries}} q GROUP BY 1, 2",
        "export_columns": f"""WITH s AS (SELECT vec_id, embedding, {_PEAK.format("{vec_corpus}")} AS s FROM {{vec_corpus}}), c AS (SELECT vec_id, {_CODE.format("", "s")} AS codes FROM s), src AS (SELECT source, row_number() OVER (ORDER BY f) - 1 AS src FROM (SELECT aoi || '/' || acq_date AS source, min(vec_id) AS f FROM {{tile_grid}} GROUP BY 1) x)
          SELECT scale, row_number() OVER (PARTITION BY scale ORDER BY vec_id) - 1 AS at, src, CAST(col * scale AS INT) AS px_x, CAST(row_ * scale AS INT) AS px_y, round(CAST(CAST(min_lon AS FLOAT) AS DOUBLE), 4) AS min_lon, round(CAST(CAST(min_lat AS FLOAT) AS DOUBLE), 4) AS min_lat,
            round(CAST(CAST(max_lon AS FLOAT) AS DOUBLE), 4) AS max_lon, round(CAST(CAST(max_lat AS FLOAT) AS DOUBLE), 4) AS max_lat, CAST(list_sum(codes) AS BIGINT) AS code_sum, CAST(codes[1] AS INT) AS first_code
          FROM {{tile_grid}} g JOIN c USING (vec_id) JOIN src ON src.source = g.aoi || '/' || g.acq_date""",
        "query_codes": f"WITH s AS (SELECT query_id, embedding, {_PEAK.format('{user_queries}')} AS s FROM {{user_queries}}) SELECT query_id, round(s, 9) AS scale_, CAST(list_sum({_CODE.format('', 's')}) AS BIGINT) AS code_sum FROM s",
        "bake_off_top": """WITH a AS (SELECT 'whole' AS candidate, query_id, scale, vec_id, round(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM {vec_corpus} c, {user_queries} q
            UNION ALL SELECT 'half', query_id, scale, vec_id, round(list_dot_product(CAST(c.embedding[1:32] AS DOUBLE[]), CAST(q.embedding[1:32] AS DOUBLE[])), 6) FROM {vec_corpus} c, {user_queries} q),
          b AS (SELECT candidate, query_id, CAST(scale AS VARCHAR) AS scope, vec_id, score FROM a UNION ALL SELECT candidate, query_id, 'all', vec_id, score FROM a)
          SELECT candidate, query_id, scope, CAST(rank AS INT) AS rank, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY candidate, query_id, scope ORDER BY score DESC, vec_id) AS rank FROM b) r WHERE rank <= 5""",
        "bake_off_spread": """WITH a AS (SELECT 'whole' AS candidate, query_id, list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM {vec_corpus} c, {user_queries} q
            UNION ALL SELECT 'half', query_id, list_dot_product(CAST(c.embedding[1:32] AS DOUBLE[]), CAST(q.embedding[1:32] AS DOUBLE[])) FROM {vec_corpus} c, {user_queries} q)
          SELECT candidate, query_id, count(*) AS n, round(min(score), 4) AS score_min, round(max(score), 4) AS score_max, round(avg(score), 4) AS score_mean FROM a GROUP BY 1, 2""",
        "files_under": "SELECT scene_id, path FROM {scenes} WHERE path LIKE 'area1/%' OR path LIKE 'area5/Brand#2%'",
        "labels_and_sides": """SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug, p_brand || CASE WHEN p_size % 3 <> 0 THEN ' ' || chr(183) || ' ' || (p_size * 16) || '-d' ELSE '' END AS label, CAST(greatest(16, least(512, p_size * 16)) AS INT) AS side FROM {part}""",
        "opening_phrases": """WITH ph AS (SELECT p_type AS phrase, min(p_partkey) AS "at" FROM {part} GROUP BY 1), c AS (SELECT n_nationkey, min(p_type) AS phrase FROM {nation} JOIN {part} ON p_size = n_nationkey AND p_size % 3 <> 0 GROUP BY 1)
          SELECT aoi, phrase, CAST(ph."at" AS INT) AS "at" FROM (SELECT n_name AS aoi, coalesce(c.phrase, (SELECT min(phrase) FROM ph)) AS phrase FROM {nation} n LEFT JOIN c ON c.n_nationkey = n.n_nationkey) o JOIN ph USING (phrase)""",
        "number_types": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'float32' WHEN s_nationkey % 10 + 1 >= 8 THEN 'bfloat16' ELSE 'float16' END AS kind FROM {supplier}",
        "gram_matrix": "WITH d AS (SELECT unnest(range(0, 64)) AS k) SELECT CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j, round(avg(CAST(embedding[a.k + 1] AS DOUBLE) * CAST(embedding[b.k + 1] AS DOUBLE)), 6) AS v FROM {embeddings}, d a, d b GROUP BY 1, 2",
        "lexical_nearest": """WITH p AS (SELECT *, string_split(lower(phrase), ' ') AS w, ['small', 'red', 'bolt'] AS q FROM {phrases}),
          s AS (SELECT phrase, category, CASE WHEN contains(lower(phrase), 'small red bolt') THEN 10 ELSE 0 END + list_sum(list_transform(q, lambda a: list_sum(list_transform(w, lambda b: CASE WHEN a = b THEN 3e0 WHEN contains(a, b) OR contains(b, a) THEN 0.5e0 ELSE 0e0 END)))) AS score FROM p)
          SELECT phrase, category, score FROM s WHERE score > 0 ORDER BY score DESC, phrase LIMIT 10""",
        "phrase_filter": "SELECT phrase, category FROM {phrases} WHERE contains(lower(phrase), 'bolt')",
        "phrase_categories": "SELECT category, count(*) AS phrases, min(phrase) AS first FROM {phrases} GROUP BY category",
        "parse_boxes": """WITH b AS (SELECT p_partkey, round(CAST('0.' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS DOUBLE) * 1280, 6) AS x1, round(CAST('0.' || lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') AS DOUBLE) * 720, 6) AS y1,
            round(CAST('0.' || lpad(CAST(p_size + p_partkey % 40 AS VARCHAR), 3, '0') AS DOUBLE) * 1280, 6) AS x2, round(CAST('0.' || lpad(CAST(p_partkey % 90 + 7 AS VARCHAR), 2, '0') AS DOUBLE) * 720, 6) AS y2 FROM {part})
          SELECT * FROM b WHERE x2 - x1 > 2 AND y2 - y1 > 2""",
        "html_block": "SELECT page_id, regexp_extract(html, '<script[^>]*>(.*?)</script>', 1, 's') AS script, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's') AS title FROM {pages}",
        "query_cleanup": "SELECT doc_id, least(length(trim(text)), 2000) AS n, length(trim(text)) > 2000 AS truncated, sha256(substr(trim(text), 1, 2000)) AS digest FROM {documents} WHERE text IS NOT NULL",
        "resume_todo": "SELECT aoi || '::' || vec_id AS tile_id FROM {tile_grid} WHERE vec_id % 3 <> 0 AND nodata_fraction < 1.0",
        "vector_checks": "SELECT vec_id AS tile_id, CASE WHEN vec_id % 11 = 0 THEN 'not_finite' ELSE 'norm' END AS problem FROM {embeddings} WHERE vec_id % 11 = 0 OR vec_id % 7 = 0",
        "vector_norms": f"SELECT label, count(*) AS n, round(min(sqrt(list_dot_product({_V.format('')}, {_V.format('')}))), 5) AS low, round(max(sqrt(list_dot_product({_V.format('')}, {_V.format('')}))), 5) AS high FROM {{embeddings}} GROUP BY label",
        "mixed_model_check": "SELECT aoi, count(DISTINCT acq_date = 'unknown') AS models, count(DISTINCT scale) AS scales, count(DISTINCT acq_date = 'unknown') > 1 AS raises FROM {vec_corpus} GROUP BY aoi",
        "stale_export": "SELECT vec_id, 'index' AS only FROM {tile_grid} WHERE acq_date = '2025-06-06'",
        "near_pairs_by_label": f"WITH l AS (SELECT label, arg_min(embedding, vec_id) AS lead FROM {{embeddings}} GROUP BY label) SELECT label, round(avg(list_dot_product({_V.format('')}, CAST(lead AS DOUBLE[]))), 6) AS mean_cosine FROM {{embeddings}} JOIN l USING (label) GROUP BY label",
    }.items()
}
