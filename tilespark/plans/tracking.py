"""Queries over boxes, tracks and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import geometry as g
from tilespark.functions import text as t
from tilespark.operators import clips, scoring, tiled, tiling, tracks
from tilespark.sources.views import oracle, table


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "boxes")


def iou_pairs(spark, sf_dir):
    found = scoring.pairs_over(_boxes(spark, sf_dir), 0.5)
    return found.select("clip_id", "frame", "gt_id", "pred_id", F.round("iou", 6).alias("iou"))


def matched_boxes(spark, sf_dir):
    """Frames where two objects and two predictions overlap each other."""
    found = scoring.matches(table(spark, sf_dir, "crowd"))
    return found.groupBy("clip_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("iou"), 6).alias("total"))


def ignore_suppression(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return scoring.suppressed(b).groupBy("clip_id").agg(F.count(F.lit(1)).alias("suppressed"))


def detection_prf(spark, sf_dir):
    return _rounded(scoring.detection(_boxes(spark, sf_dir)))


def clear_mot(spark, sf_dir):
    return _rounded(scoring.clear_mot(_boxes(spark, sf_dir)))


def idf1_counts(spark, sf_dir):
    return scoring.cooccurrence(_boxes(spark, sf_dir))


def idf1(spark, sf_dir):
    return _rounded(scoring.idf1(_boxes(spark, sf_dir)))


def grounding_recall(spark, sf_dir):
    found = scoring.clip_grounding(scoring.grounding(_boxes(spark, sf_dir)))
    return found.withColumn("median_latency", F.col("median_latency").cast("double"))


def clip_pooling(spark, sf_dir):
    """Over clips: grounding pooled over targets, MOTA and IDF1 averaged."""
    return _rounded(clips.pooled(clips.evaluated(_boxes(spark, sf_dir))).select("clips", "recall", "mota", "idf1"))


def clip_counts(spark, sf_dir):
    """Labelled frames, tracks and boxes per clip; boxes that an ignored region excuses are counted apart."""
    b = _boxes(spark, sf_dir)
    on = lambda c: F.when(c, F.col("track_id"))
    gt, ignored = (F.col("side") == "gt") & ~F.col("ignore"), F.col("ignore")
    hidden = scoring.suppressed(b).groupBy("clip_id").agg(F.count(F.lit(1)).alias("pred_boxes_suppressed"))
    counts = scoring.labelled(b).groupBy("clip_id").agg(
        F.countDistinct("frame").alias("frames"), F.countDistinct(on(gt)).alias("gt_tracks"), F.countDistinct(on(ignored)).alias("ignore_tracks"), F.count_if(gt).alias("gt_boxes"),
        F.countDistinct(on(F.col("side") == "pred")).alias("pred_tracks"), F.count_if(F.col("side") == "pred").alias("pred_boxes"),
    )
    joined = counts.join(hidden, "clip_id", "left").withColumn("pred_boxes_suppressed", F.coalesce("pred_boxes_suppressed", F.lit(0)))
    return joined.withColumn("pred_boxes", F.col("pred_boxes") - F.col("pred_boxes_suppressed"))


def clip_report(spark, sf_dir):
    """What a person reads of each clip: grounding, detection and tracking, a line each."""
    scores = clips.evaluated(_boxes(spark, sf_dir))
    three = lambda *names: [F.bround(c, 3) for c in names]
    lines = (
        F.format_string("grounding %d/%d (%d of %d late)", "grounded", "total", "late_grounded", "late_total"),
        F.format_string("P %.3f R %.3f F1 %.3f (%d tp, %d fp, %d fn, %d suppressed)", *three("precision", "recall", "f1"), "tp", "fp", "fn", "pred_boxes_suppressed"),
        F.format_string("MOTA %.3f IDF1 %.3f MOTP %.3f switches %d", *three("mota", "idf1", "motp"), "id_switches"),
    )
    return scores.select("clip_id", F.concat_ws("\n", *lines).alias("report"))


def _clips(spark, sf_dir):
    declared = F.when(F.col("declared"), F.sequence(F.lit(0), F.lit(39)))
    c = table(spark, sf_dir, "clip_table").withColumn("frames", declared)
    return c, clips.evaluated(table(spark, sf_dir, "clip_boxes"), c)


def clip_scores(spark, sf_dir):
    """Every declared clip with all its numbers: clips without targets and without boxes have their rows."""
    return _rounded(_clips(spark, sf_dir)[1].drop("per_track"))


def track_scores(spark, sf_dir):
    """Every scored track: when it was found, and how long its own prediction follows it."""
    return clips.track_rows(_clips(spark, sf_dir)[1]).drop("match_id")


def clip_pooled(spark, sf_dir):
    return _rounded(clips.pooled(_clips(spark, sf_dir)[1]))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _detections(spark, sf_dir):
    """Predictions as tile-local boxes of one wide frame for every clip and frame: lane 4 reaches over x = 448 and is cut there by the first tile.
    On even frames the second tile sees it whole, on odd ones it is longer and each tile has a part."""
    d = table(spark, sf_dir, "det_boxes").filter("pred_id IS NOT NULL")
    frame = (F.col("clip_id").cast("long") * 60 + F.col("frame")).alias("frame_id")
    longer = F.when((F.col("gt_id") == 4) & (F.col("frame") % 2 == 1), 35).otherwise(0)
    wide = d.select(frame, (F.col("gt_id") * 120 - 60 - longer).cast("double").alias("left"), (F.col("gt_id") * 120 + 12).cast("double").alias("right"), (F.col("dx") / 10).alias("low"))
    tiles = spark.range(2).select(F.col("id").cast("int").alias("tile"), (F.col("id") * 400).alias("x0"), (F.col("id") * 400 + 448).alias("x1"))
    cut = wide.join(F.broadcast(tiles), (F.col("left") < F.col("x1")) & (F.col("right") > F.col("x0")))
    return cut.select("frame_id", "tile", (F.col("left") - F.col("x0")).alias("x1"), F.col("low").alias("y1"), (F.col("right") - F.col("x0")).alias("x2"), (F.col("low") + 20).alias("y2"), F.lit(1.0).alias("score"))


def _frame_tiles(spark, sf_dir):
    f = table(spark, sf_dir, "det_boxes").select((F.col("clip_id").cast("long") * 60 + F.col("frame")).alias("frame_id")).distinct()
    tiles = tiling.frame_tiles(f.select("frame_id", F.lit(848).alias("width"), F.lit(448).alias("height")), 448, 0.0)
    return tiles.select("frame_id", F.col("col").cast("int").alias("tile"), "x0", "y0", "x1", "y1", F.lit(848).alias("width"), F.lit(448).alias("height"))


def seam_flags(spark, sf_dir):
    found = tiled.in_frame(_detections(spark, sf_dir), _frame_tiles(spark, sf_dir))
    return found.select("frame_id", "tile", "x1", "y1", "x2", "y2", F.array_join(F.transform("seams", lambda s: s.cast("int").cast("string")), "").alias("seams"))


def seam_duplicates(spark, sf_dir):
    found = tiled.in_frame(_detections(spark, sf_dir), _frame_tiles(spark, sf_dir))
    return tiled.seam_duplicates(found).select("frame_id", "tile", "x1", "x2")


def nms(spark, sf_dir):
    b = table(spark, sf_dir, "boxes")
    return tiled.suppressed(b.select((F.col("clip_id").cast("long") * 60 + F.col("frame")).alias("frame_id"), (F.col("side") == "gt").cast("int").alias("tile"), "x1", "y1", "x2", "y2", F.when(F.col("side") == "gt", 0.5).otherwise(0.9).alias("score"), F.array(*[F.lit(False)] * 4).alias("seams")))


def stitch(spark, sf_dir):
    return tiled.stitched(tiled.in_frame(_detections(spark, sf_dir), _frame_tiles(spark, sf_dir)))


def ground_tiled(spark, sf_dir):
    return tiled.reconciled(tiled.in_frame(_detections(spark, sf_dir), _frame_tiles(spark, sf_dir)))


def box_union(spark, sf_dir):
    d = table(spark, sf_dir, "det_boxes")
    u = g.joined(g.box("gx1", "gy1", F.col("gx1") + 10, F.col("gy1") + 10), g.box(F.col("gx1") + F.col("dx"), "gy1", F.col("gx1") + F.col("dx") + 10, F.col("gy1") + 10))
    return d.select("clip_id", "frame", "gt_id", u["x1"].alias("x1"), u["y1"].alias("y1"), u["x2"].alias("x2"), u["y2"].alias("y2"))


def mask_bbox(spark, sf_dir):
    p = table(spark, sf_dir, "pixels").filter("b1 = 3")
    return p.groupBy("raster_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("pixels"))


def trajectory_phases(spark, sf_dir):
    return tracks.phases(table(spark, sf_dir, "points"), 10.0)


def trajectory_text(spark, sf_dir):
    return tracks.described(tracks.phases(table(spark, sf_dir, "points"), 10.0), 10.0)


def reacquisition(spark, sf_dir):
    seen = table(spark, sf_dir, "det_boxes").filter("pred_id IS NOT NULL").select("clip_id", "frame", F.col("gt_id").alias("object_id"))
    return tracks.acquisitions(seen, 5)


def reacquired_boxes(spark, sf_dir):
    """Predictions that overlap no ground truth of their frame by 0.3 or more."""
    b = table(spark, sf_dir, "boxes")
    xy = ["x1", "y1", "x2", "y2"]
    over = g.iou(g.box(*[f"o.{c}" for c in xy]), g.box(*[f"l.{c}" for c in xy]))
    return tracks.reacquired(b.filter("side = 'gt'"), b.filter("side = 'pred'"), over).select("clip_id", "frame", F.col("track_id").alias("pred_id"))


def keyword_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return tracks.keyword_matches("the small, red BOLT part.", p, "label", F.lit(True)).select("p_partkey", "label")


def compass(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 21 - 10).alias("dx"), (F.col("p_size") % 21 - 10).alias("dy"))
    return p.select("p_partkey", t.octant(F.col("dx").cast("double"), F.col("dy").cast("double")).alias("direction"))


def oriented_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", tracks.oriented_box(F.lit(100.0), F.lit(50.0), F.lit(40.0), F.lit(18.0), F.col("p_size") * 7.0).alias("b"))
    return p.select("p_partkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def frame_selection(spark, sf_dir):
    """Frames kept of videos at several rates when at most 10 a second are wanted."""
    p = table(spark, sf_dir, "points").withColumn("fps", (F.col("user_id") % 5 + 1) * 12.0)
    stride = F.greatest(F.lit(1), F.bround(F.col("fps") / 10.0, 0).cast("int"))
    return p.withColumn("stride", stride).filter(F.col("frame") % F.col("stride") == 0).groupBy("user_id").agg(F.max("stride").alias("stride"), F.count(F.lit(1)).alias("frames"))


QUERIES = {
    f.__name__: f
    for f in (iou_pairs, matched_boxes, ignore_suppression, detection_prf, clear_mot, idf1_counts, idf1, grounding_recall, clip_pooling, clip_counts, clip_report, seam_flags, seam_duplicates, nms, stitch, ground_tiled, box_union, mask_bbox, trajectory_phases, trajectory_text, reacquisition, reacquired_boxes, keyword_match, compass, oriented_boxes, frame_selection, clip_scores, track_scores, clip_pooled)
}

_IOU = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / (200 - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_LABELLED = "lab AS (SELECT * FROM {boxes} WHERE (clip_id, frame) IN (SELECT (clip_id, frame) FROM {boxes} WHERE side = 'gt'))"
_NEAR = f"""{_LABELLED}, near AS (SELECT a.clip_id, a.frame, a.track_id AS gt_id, a.ignore, b.track_id AS pred_id, a.acquired_frame, {_IOU} AS iou FROM lab a JOIN lab b
  ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.side = 'gt' AND b.side = 'pred' AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
over AS (SELECT * FROM near WHERE iou >= 0.5 AND NOT ignore),
hits AS (SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY clip_id, frame, gt_id ORDER BY iou DESC) = 1),
hidden AS (SELECT DISTINCT clip_id, frame, pred_id FROM near WHERE iou >= 0.5 AND ignore),
seen AS (SELECT * FROM lab WHERE (side = 'gt' AND NOT ignore) OR (side = 'pred' AND (clip_id, frame, track_id) NOT IN (SELECT (clip_id, frame, pred_id) FROM hidden))),
n AS (SELECT clip_id, count(*) FILTER (side = 'gt') AS n_gt, count(*) FILTER (side = 'pred') AS n_pred FROM seen GROUP BY clip_id),
tp AS (SELECT clip_id, count(*) AS tp, avg(iou) AS mean_iou, sum(iou) AS total FROM hits GROUP BY clip_id)"""
_SWITCH = """latest AS (SELECT *, last_value(pred_id IGNORE NULLS) OVER (PARTITION BY clip_id, gt_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
sw AS (SELECT clip_id, count(*) FILTER (before IS NOT NULL AND before <> pred_id) AS id_switches FROM latest GROUP BY clip_id)"""
_MOT = """mot AS (SELECT n.clip_id, round(1 - (n_gt - tp + n_pred - tp + id_switches) / CAST(n_gt AS DOUBLE), 6) AS mota, round(mean_iou, 6) AS motp, id_switches, tp, n_pred - tp AS fp, n_gt - tp AS fn FROM n JOIN tp USING (clip_id) JOIN sw USING (clip_id))"""
_CO = "co AS (SELECT clip_id, gt_id, pred_id, count(*) AS frames FROM over GROUP BY 1, 2, 3)"
_ID = """best AS (SELECT clip_id, sum(f) AS idtp FROM (SELECT clip_id, gt_id, max(frames) AS f FROM co GROUP BY 1, 2) x GROUP BY clip_id),
ids AS (SELECT n.clip_id, CAST(idtp AS BIGINT) AS idtp, CAST(n_pred - idtp AS BIGINT) AS idfp, CAST(n_gt - idtp AS BIGINT) AS idfn, round(2 * idtp / CAST(n_gt + n_pred AS DOUBLE), 6) AS idf1, round(idtp / CAST(n_pred AS DOUBLE), 6) AS idp, round(idtp / CAST(n_gt AS DOUBLE), 6) AS idr FROM n JOIN best USING (clip_id))"""
_GROUND = """glab AS (SELECT * FROM {boxes} WHERE (clip_id, frame) IN (SELECT (clip_id, frame) FROM {boxes} WHERE side = 'gt')),
acq AS (SELECT clip_id, track_id AS pred_id, min(acquired_frame) AS acquired FROM {boxes} WHERE side = 'pred' GROUP BY 1, 2),
gt AS (SELECT clip_id, track_id AS gt_id, min(frame) AS first FROM glab WHERE side = 'gt' AND NOT ignore GROUP BY 1, 2),
pairs AS (SELECT a.clip_id, a.frame, a.track_id AS gt_id, b.track_id AS pred_id, CASE WHEN a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 THEN @IOU@ ELSE 0 END AS iou FROM glab a JOIN glab b
  ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.side = 'gt' AND b.side = 'pred'),
checked AS (SELECT p.clip_id, p.gt_id, p.pred_id, arg_min(iou, frame) AS iou, any_value(acquired) AS acquired, any_value(first) AS first FROM pairs p JOIN acq USING (clip_id, pred_id) JOIN gt USING (clip_id, gt_id)
  WHERE frame >= acquired AND acquired <= first + 30 GROUP BY 1, 2, 3),
found AS (SELECT clip_id, gt_id, greatest(0, acquired - first) AS latency FROM checked WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY clip_id, gt_id ORDER BY iou DESC, pred_id) = 1),
g AS (SELECT gt.clip_id, gt.gt_id, first > 30 AS late, latency IS NOT NULL AS grounded, latency FROM gt LEFT JOIN found USING (clip_id, gt_id)),
ground AS (SELECT clip_id, count(*) AS total, count(*) FILTER (grounded) AS grounded, count(*) FILTER (NOT late) AS initial_total, count(*) FILTER (grounded AND NOT late) AS initial_grounded,
  count(*) FILTER (late) AS late_total, count(*) FILTER (grounded AND late) AS late_grounded, CAST(median(latency) AS DOUBLE) AS median_latency, CAST(max(latency) AS BIGINT) AS max_latency FROM g GROUP BY clip_id)""".replace("@IOU@", _IOU)
_TILED = """d AS (SELECT CAST(clip_id AS BIGINT) * 60 + frame AS frame_id, CAST(gt_id * 120 - 60 - CASE WHEN gt_id = 4 AND frame % 2 = 1 THEN 35 ELSE 0 END AS DOUBLE) AS l, gt_id = 4 AND frame % 2 = 1 AS parted, CAST(gt_id * 120 + 12 AS DOUBLE) AS r, dx / 10 AS low FROM {det_boxes} WHERE pred_id IS NOT NULL),
cut AS (SELECT frame_id, parted, CAST(t AS INT) AS tile, greatest(l, t * 400) AS x1, low AS y1, least(r, t * 400 + 448) AS x2, low + 20 AS y2 FROM d, (SELECT unnest([0, 1]) AS t) tt WHERE l < t * 400 + 448 AND r > t * 400),
flagged AS (SELECT *, tile = 1 AND x1 - 400 <= 2 AS sl, tile = 0 AND 448 - x2 <= 2 AS sr FROM cut)"""
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_PHASES = """p AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM {points} WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
s AS (SELECT *, lead(frame) OVER w AS frame1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WHERE k % 10 = 0 OR k = last WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
st AS (SELECT *, CASE WHEN sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / greatest((frame1 - frame) / CAST(10 AS DOUBLE), 1e-6) < 4 THEN 'stationary'
  ELSE 'moves ' || ['east', 'southeast', 'south', 'southwest', 'west', 'northwest', 'north', 'northeast'][CAST(floor(((degrees(atan2(y1 - y, x1 - x)) + 22.5 + 360) % 360) / 45) AS INT) + 1] END AS state FROM s WHERE frame1 IS NOT NULL),
i AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY user_id ORDER BY frame) THEN 1 ELSE 0 END AS fresh FROM st),
ph AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY frame) AS BIGINT) AS phase FROM i),
phases AS (SELECT user_id, phase, any_value(state) AS state, min(frame) AS start_frame, max(frame1) AS end_frame FROM ph GROUP BY 1, 2)"""

# the same over declared clips: frames that were declared, else those with ground truth
_DECLARED = """fr AS (SELECT clip_id, CAST(unnest(range(40)) AS INT) AS frame FROM {clip_table} WHERE declared UNION SELECT DISTINCT clip_id, frame FROM {clip_boxes} WHERE side = 'gt' AND clip_id NOT IN (SELECT clip_id FROM {clip_table} WHERE declared)), lab AS (SELECT * FROM {clip_boxes} WHERE (clip_id, frame) IN (SELECT (clip_id, frame) FROM fr))"""
_CLIPS = f"{_NEAR.replace(_LABELLED, _DECLARED)}, {_SWITCH}, {_CO}, " + _GROUND.replace("SELECT * FROM {boxes} WHERE (clip_id, frame) IN (SELECT (clip_id, frame) FROM {boxes} WHERE side = 'gt')", "SELECT * FROM lab").replace("{boxes}", "{clip_boxes}") + """,
longest AS (SELECT clip_id, gt_id, CAST(max(frames) AS BIGINT) AS idtp FROM co GROUP BY 1, 2), best AS (SELECT clip_id, CAST(sum(idtp) AS BIGINT) AS idtp FROM longest GROUP BY 1),
sides AS (SELECT clip_id, count(DISTINCT track_id) FILTER (side = 'gt' AND NOT ignore) AS gt_tracks, count(DISTINCT track_id) FILTER (ignore) AS ignore_tracks, count(DISTINCT track_id) FILTER (side = 'pred') AS pred_tracks FROM {clip_boxes} GROUP BY 1),
every AS (SELECT c.clip_id, (SELECT count(*) FROM fr WHERE fr.clip_id = c.clip_id) AS labeled_frames, coalesce(s.gt_tracks, 0) AS gt_tracks, coalesce(s.ignore_tracks, 0) AS ignore_tracks, coalesce(n_gt, 0) AS gt_boxes, coalesce(s.pred_tracks, 0) AS pred_tracks,
  coalesce(n_pred, 0) AS pred_boxes, (SELECT count(*) FROM hidden h WHERE h.clip_id = c.clip_id) AS pred_boxes_suppressed, coalesce(tp.tp, 0) AS tp, coalesce(tp.mean_iou, 0) AS mean_iou, coalesce(sw.id_switches, 0) AS id_switches, coalesce(best.idtp, 0) AS idtp,
  coalesce(g.total, 0) AS total, coalesce(g.grounded, 0) AS grounded, coalesce(g.initial_total, 0) AS initial_total, coalesce(g.initial_grounded, 0) AS initial_grounded, coalesce(g.late_total, 0) AS late_total, coalesce(g.late_grounded, 0) AS late_grounded, median_latency, max_latency
  FROM {clip_table} c LEFT JOIN sides s USING (clip_id) LEFT JOIN n USING (clip_id) LEFT JOIN tp USING (clip_id) LEFT JOIN sw USING (clip_id) LEFT JOIN best USING (clip_id) LEFT JOIN ground g USING (clip_id)),
ratios AS (SELECT *, pred_boxes - tp AS fp, gt_boxes - tp AS fn, tp AS mot_tp, pred_boxes - tp AS mot_fp, gt_boxes - tp AS mot_fn, pred_boxes - idtp AS idfp, gt_boxes - idtp AS idfn,
  coalesce(tp / CAST(nullif(pred_boxes, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(gt_boxes, 0) AS DOUBLE), 0) AS recall, coalesce(2e0 * tp / nullif(pred_boxes + gt_boxes, 0), 0) AS f1, mean_iou AS motp,
  coalesce(1 - (gt_boxes - tp + pred_boxes - tp + id_switches) / CAST(nullif(gt_boxes, 0) AS DOUBLE), 0) AS mota, coalesce(2e0 * idtp / nullif(pred_boxes + gt_boxes, 0), 0) AS idf1, coalesce(idtp / CAST(nullif(pred_boxes, 0) AS DOUBLE), 0) AS idp, coalesce(idtp / CAST(nullif(gt_boxes, 0) AS DOUBLE), 0) AS idr FROM every)"""
_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in clips.RATIOS)

ORACLE = {
    name: oracle(sql)
    for name, sql in {
        "iou_pairs": f"WITH near AS (SELECT a.clip_id, a.frame, a.track_id AS gt_id, a.ignore, b.track_id AS pred_id, {_IOU} AS iou FROM {{boxes}} a JOIN {{boxes}} b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.side = 'gt' AND b.side = 'pred' AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2) SELECT clip_id, frame, gt_id, pred_id, round(iou, 6) AS iou FROM near WHERE iou >= 0.5 AND NOT ignore",
        # lanes apart: two objects and two predictions a lane at most, so a matching is one pair or two
        "matched_boxes": f"""WITH e AS (SELECT a.clip_id, a.frame, CAST(a.y1 AS INT) AS lane, a.track_id AS g, b.track_id AS p, {_IOU} AS iou FROM {{crowd}} a JOIN {{crowd}} b
            ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.side = 'gt' AND b.side = 'pred' AND a.y1 = b.y1 AND a.x1 < b.x2 AND b.x1 < a.x2 WHERE {_IOU} >= 0.5),
          c AS (SELECT clip_id, frame, lane, 1 AS n, iou AS total FROM e UNION ALL SELECT e.clip_id, e.frame, e.lane, 2, e.iou + f.iou FROM e JOIN e f ON e.clip_id = f.clip_id AND e.frame = f.frame AND e.lane = f.lane AND e.g < f.g AND e.p <> f.p),
          t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY clip_id, frame, lane ORDER BY total DESC) = 1)
          SELECT clip_id, CAST(sum(n) AS BIGINT) AS pairs, round(sum(total), 6) AS total FROM t GROUP BY clip_id""",
        "ignore_suppression": f"WITH {_NEAR} SELECT clip_id, count(*) AS suppressed FROM hidden GROUP BY clip_id",
        "detection_prf": f"""WITH {_NEAR}, c AS (SELECT clip_id, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn, (SELECT count(*) FROM hidden h WHERE h.clip_id = n.clip_id) AS suppressed, round(coalesce(mean_iou, 0), 6) AS mean_iou FROM n LEFT JOIN tp USING (clip_id))
          SELECT *, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c""",
        "clear_mot": f"WITH {_NEAR}, {_SWITCH}, {_MOT} SELECT * FROM mot",
        "idf1_counts": f"WITH {_NEAR}, {_CO} SELECT * FROM co",
        "idf1": f"WITH {_NEAR}, {_CO}, {_ID} SELECT * FROM ids",
        "grounding_recall": f"WITH {_GROUND} SELECT * FROM ground",
        "clip_pooling": f"WITH {_NEAR}, {_SWITCH}, {_MOT}, {_CO}, {_ID}, {_GROUND} SELECT count(*) AS clips, round(sum(grounded) / CAST(sum(ground.total) AS DOUBLE), 6) AS recall, round(avg(1 - (n_gt - tp.tp + n_pred - tp.tp + sw.id_switches) / CAST(n_gt AS DOUBLE)), 6) AS mota, round(avg(2 * idtp / CAST(n_gt + n_pred AS DOUBLE)), 6) AS idf1 FROM ground JOIN n USING (clip_id) JOIN tp USING (clip_id) JOIN sw USING (clip_id) JOIN best USING (clip_id)",
        "clip_counts": f"""WITH {_NEAR}, flagged AS (SELECT *, side = 'pred' AND (clip_id, frame, track_id) IN (SELECT (clip_id, frame, pred_id) FROM hidden) AS h FROM lab)
          SELECT clip_id, count(DISTINCT frame) AS frames, count(DISTINCT track_id) FILTER (side = 'gt' AND NOT ignore) AS gt_tracks, count(DISTINCT track_id) FILTER (ignore) AS ignore_tracks, count(*) FILTER (side = 'gt' AND NOT ignore) AS gt_boxes,
          count(DISTINCT track_id) FILTER (side = 'pred') AS pred_tracks, count(*) FILTER (side = 'pred' AND NOT h) AS pred_boxes, count(*) FILTER (h) AS pred_boxes_suppressed FROM flagged GROUP BY clip_id""",
        "clip_report": f"""WITH {_NEAR}, {_SWITCH}, {_MOT}, {_CO}, {_ID}, {_GROUND},
          c AS (SELECT clip_id, n.n_gt, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn, (SELECT count(*) FROM hidden h WHERE h.clip_id = n.clip_id) AS suppressed, mean_iou FROM n LEFT JOIN tp USING (clip_id))
          SELECT clip_id, printf('grounding %d/%d (%d of %d late)', grounded, ground.total, late_grounded, late_total) || chr(10) ||
            printf('P %.3f R %.3f F1 %.3f (%d tp, %d fp, %d fn, %d suppressed)', round_even(c.tp / CAST(c.tp + c.fp AS DOUBLE), 3), round_even(c.tp / CAST(c.tp + c.fn AS DOUBLE), 3), round_even(2.0e0 * c.tp / (2 * c.tp + c.fp + c.fn), 3), c.tp, c.fp, c.fn, suppressed) || chr(10) ||
            printf('MOTA %.3f IDF1 %.3f MOTP %.3f switches %d', round_even(1 - (c.fn + c.fp + sw.id_switches) / CAST(n.n_gt AS DOUBLE), 3), round_even(2 * idtp / CAST(n.n_gt + n.n_pred AS DOUBLE), 3), round_even(c.mean_iou, 3), sw.id_switches) AS report
          FROM c JOIN n USING (clip_id) JOIN sw USING (clip_id) JOIN best USING (clip_id) JOIN ground USING (clip_id)""",
        "clip_scores": f"WITH {_CLIPS} SELECT clip_id, {', '.join(clips.COUNTS)}, {_SIX}, median_latency, max_latency FROM ratios",
        "track_scores": f"""WITH {_CLIPS} SELECT t.clip_id, t.gt_id, '' AS label, (SELECT count(*) FROM lab WHERE lab.clip_id = t.clip_id AND lab.side = 'gt' AND lab.track_id = t.gt_id) AS boxes, coalesce(g.late, false) AS late_entry, coalesce(g.grounded, false) AS grounded,
          f.pred_id, g.latency, coalesce(l.idtp, 0) AS idtp FROM (SELECT DISTINCT clip_id, track_id AS gt_id FROM {{clip_boxes}} WHERE side = 'gt' AND NOT ignore) t LEFT JOIN g USING (clip_id, gt_id) LEFT JOIN longest l USING (clip_id, gt_id)
          LEFT JOIN (SELECT clip_id, gt_id, pred_id FROM checked WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY clip_id, gt_id ORDER BY iou DESC, pred_id) = 1) f USING (clip_id, gt_id)""",
        "clip_pooled": f"WITH {_CLIPS} SELECT count(*) AS clips, count(*) FILTER (gt_boxes = 0) AS negative_clips, round(sum(grounded) / CAST(sum(total) AS DOUBLE), 6) AS recall, round(avg(mota), 6) AS mota, round(avg(idf1), 6) AS idf1, CAST(coalesce(sum(fp) FILTER (gt_boxes = 0), 0) AS BIGINT) AS negative_fp FROM ratios",
        "seam_flags": f"WITH {_TILED} SELECT frame_id, tile, x1, y1, x2, y2, CAST(CAST(sl AS INT) AS VARCHAR) || '0' || CAST(CAST(sr AS INT) AS VARCHAR) || '0' AS seams FROM flagged",
        "seam_duplicates": f"""WITH {_TILED} SELECT frame_id, tile, x1, x2 FROM flagged d WHERE (sl OR sr) AND EXISTS (SELECT 1 FROM cut o WHERE o.frame_id = d.frame_id AND o.tile <> d.tile AND {_AREA.format("o")} > {_AREA.format("d")}
          AND greatest(0, least(d.x2, o.x2) - greatest(d.x1, o.x1)) * greatest(0, least(d.y2, o.y2) - greatest(d.y1, o.y1)) / ({_AREA.format("d")}) >= 0.6)""",
        # boxes of 10 by 10 in one lane overlap by half where they are 3 apart at most; the further left goes first among predictions
        "nms": """WITH p AS (SELECT * FROM {boxes} WHERE side = 'pred'),
          k AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.clip_id = p.clip_id AND q.frame = p.frame AND q.y1 = p.y1 AND q.x1 < p.x1 AND p.x1 - q.x1 <= 3)),
          g AS (SELECT * FROM {boxes} b WHERE side = 'gt' AND NOT EXISTS (SELECT 1 FROM k WHERE k.clip_id = b.clip_id AND k.frame = b.frame AND k.y1 = b.y1 AND abs(k.x1 - b.x1) <= 3))
          SELECT CAST(clip_id AS BIGINT) * 60 + frame AS frame_id, x1, y1, x2, y2, CASE side WHEN 'gt' THEN 0.5e0 ELSE 0.9e0 END AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM g) u""",
        "stitch": f"""WITH {_TILED} SELECT frame_id, x1, y1, x2, y2, 1e0 AS score FROM cut WHERE NOT parted
          UNION ALL SELECT frame_id, min(x1), min(y1), max(x2), max(y2), 1e0 FROM cut WHERE parted GROUP BY frame_id""",
        "ground_tiled": f"""WITH {_TILED} SELECT frame_id, l AS x1, low AS y1, least(r, 848) AS x2, low + 20 AS y2, 1e0 AS score FROM d""",
        "box_union": "SELECT clip_id, frame, gt_id, gx1 AS x1, gy1 AS y1, gx1 + dx + 10 AS x2, gy1 + 10 AS y2 FROM {det_boxes}",
        "mask_bbox": "SELECT raster_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS pixels FROM {pixels} WHERE b1 = 3 GROUP BY raster_id",
        "trajectory_phases": f"WITH {_PHASES} SELECT * FROM phases",
        "trajectory_text": f"WITH {_PHASES} SELECT user_id, string_agg(state || ' (' || printf('%.1f', start_frame / CAST(10 AS DOUBLE)) || '-' || printf('%.1f', end_frame / CAST(10 AS DOUBLE)) || 's)', '; ' ORDER BY phase) || '.' AS text FROM phases GROUP BY user_id",
        "reacquisition": """WITH a AS (SELECT clip_id, gt_id AS object_id, min(frame) AS acquired_frame FROM {det_boxes} WHERE pred_id IS NOT NULL AND frame % 5 = 0 GROUP BY 1, 2)
          SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY acquired_frame, object_id) AS INT) AS track_id FROM a""",
        "reacquired_boxes": f"WITH {_NEAR} SELECT b.clip_id, b.frame, b.track_id AS pred_id FROM {{boxes}} b WHERE side = 'pred' AND NOT EXISTS (SELECT 1 FROM near x WHERE x.clip_id = b.clip_id AND x.frame = b.frame AND x.pred_id = b.track_id AND x.iou >= 0.3)",
        "keyword_match": """WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS label FROM {part}),
          n AS (SELECT *, len(list_intersect(list_distinct(list_transform(string_split_regex(trim(label), '\\s+'), lambda w: lower(trim(w, '.,')))), ['bolt', 'part', 'red', 'small', 'the'])) AS n FROM p)
          SELECT p_partkey, label FROM n WHERE n > 0 AND n = (SELECT max(n) FROM n)""",
        "compass": """SELECT p_partkey, ['east', 'southeast', 'south', 'southwest', 'west', 'northwest', 'north', 'northeast'][CAST(floor(((degrees(atan2(CAST(p_size % 21 - 10 AS DOUBLE), CAST(p_partkey % 21 - 10 AS DOUBLE))) + 22.5 + 360) % 360) / 45) AS INT) + 1] AS direction FROM {part}""",
        "oriented_boxes": """WITH w AS (SELECT p_partkey, (40 * abs(cos(radians(p_size * 7e0))) + 18 * abs(sin(radians(p_size * 7e0)))) / 2 AS w, (40 * abs(sin(radians(p_size * 7e0))) + 18 * abs(cos(radians(p_size * 7e0)))) / 2 AS h FROM {part})
          SELECT p_partkey, round(100 - w, 6) AS x1, round(50 - h, 6) AS y1, round(100 + w, 6) AS x2, round(50 + h, 6) AS y2 FROM w""",
        "frame_selection": "WITH p AS (SELECT *, greatest(1, CAST(round_even((user_id % 5 + 1) * 12 / CAST(10 AS DOUBLE), 0) AS INT)) AS stride FROM {points}) SELECT user_id, max(stride) AS stride, count(*) AS frames FROM p WHERE frame % stride = 0 GROUP BY user_id",
    }.items()
}
