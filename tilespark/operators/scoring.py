"""Scoring of predicted tracks against ground truth, clip by clip, on labelled frames only.

Boxes are rows of ``clip_id, side ('gt' or 'pred'), track_id, ignore, acquired_frame, frame, x1, y1, x2, y2``. Labelled frames are those given
(``clip_id, frame``), else every frame with ground truth; whatever is predicted elsewhere neither helps nor harms. :func:`settled` brings the boxes of a frame
together once, and finds what overlaps, what is matched and what an ignored region excuses; all metrics are read from its rows. Only what is
sequential by definition (assignment, associations carried from frame to frame, greedy claims) runs in Python, a frame or a clip at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions.geometry import box, iou
from tilespark.operators.matching import assign, greedy_pairs, iou_matrix

XY = ["x1", "y1", "x2", "y2"]


def prf(tp, fp, fn) -> list:
    """precision, recall and f1 with zero for empty denominators."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def labelled(boxes: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Boxes on labelled frames: those given, else every frame with ground truth (ignored tracks too)."""
    wanted = frames if frames is not None else boxes.filter("side = 'gt'").select("clip_id", "frame").distinct()
    return boxes.join(wanted, ["clip_id", "frame"], "left_semi")


def pairs_over(boxes: DataFrame, threshold: float, ignored: bool = False) -> DataFrame:
    """Ground truth and predicted boxes of one frame that overlap enough; equal clip and frame is the join's key."""
    side = lambda s, p: s.select("clip_id", "frame", F.col("track_id").alias(f"{p}_id"), box(*XY).alias(f"{p}_box"))
    gt = side(boxes.filter((F.col("side") == "gt") & (F.col("ignore") == ignored)), "gt")
    pred = side(boxes.filter("side = 'pred'"), "pred")
    joined = gt.join(pred, ["clip_id", "frame"]).withColumn("iou", iou(F.col("gt_box"), F.col("pred_box")))
    return joined.filter(F.col("iou") >= threshold).select("clip_id", "frame", "gt_id", "pred_id", "iou")


def _solved(pairs: list[tuple[int, int, float]], greedy: bool) -> list[tuple[int, int, float]]:
    """One-to-one pairs among (gt, pred, overlap): all of them if none meets another, else those of the largest total overlap (or the best first)."""
    gt, pred = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
    if all(n == 1 for n in gt.values()) and all(n == 1 for n in pred.values()):
        return pairs
    g, p = list(gt), list(pred)
    value = np.zeros((len(g), len(p)))
    for i, j, v in pairs:
        value[g.index(i), p.index(j)] = v
    chosen = greedy_pairs(value, np.nextafter(0, 1)) if greedy else [(i, j) for i, j in assign(value) if value[i, j] > 0]
    return [(g[i], p[j], float(value[i, j])) for i, j in chosen]


_PAIRS = pa.list_(pa.struct([("gt_id", pa.int32()), ("pred_id", pa.int32()), ("iou", pa.float64())]))


def settled(boxes: DataFrame, threshold: float = 0.5, greedy: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """A row of each labelled frame with boxes: ``clip_id, frame, n_gt, n_pred`` (without what is suppressed), ``near`` (pairs of
    scored truth and visible prediction that overlap enough), ``matched`` (one to one) and ``hidden`` (suppressed predictions)."""
    if frames is not None:
        boxes = labelled(boxes, frames)
    one = F.struct((F.col("side") == "gt").alias("gt"), "ignore", F.col("track_id").cast("int").alias("id"), *[F.col(c).cast("double").alias(c) for c in XY])
    together = boxes.groupBy("clip_id", "frame").agg(F.array_sort(F.collect_list(one)).alias("b"))
    if frames is None:
        together = together.filter(F.exists("b", lambda x: x["gt"]))
    kind = boxes.schema["clip_id"].dataType.simpleString(), boxes.schema["frame"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("b")
            flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            is_gt, ignored, ids = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False)) for c in ("gt", "ignore", "id"))
            xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in XY], axis=1) if len(flat) else np.zeros((0, 4))
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                gt, pred = lo + np.flatnonzero(is_gt[lo:hi]), lo + np.flatnonzero(~is_gt[lo:hi])
                overlap = iou_matrix(xy[gt], xy[pred])
                rows, columns = np.nonzero(overlap >= threshold)
                near = [(int(ids[gt[i]]), int(ids[pred[j]]), float(overlap[i, j]), bool(ignored[gt[i]])) for i, j in zip(rows.tolist(), columns.tolist(), strict=True)]
                scored = [p[:3] for p in near if not p[3]]
                matched = _solved(scored, greedy)
                taken = {p[1] for p in matched}
                hidden = sorted({p[1] for p in near if p[3]} - taken)
                away = set(hidden)
                out.append((int((~ignored[gt]).sum()), len(pred) - len(hidden), [p for p in scored if p[1] not in away], matched, hidden))
            named = lambda pairs: [dict(zip(("gt_id", "pred_id", "iou"), p, strict=True)) for p in pairs]
            columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([named(o[2]) for o in out], _PAIRS), pa.array([named(o[3]) for o in out], _PAIRS), pa.array([o[4] for o in out], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("frame"), *columns], ["clip_id", "frame", "n_gt", "n_pred", "near", "matched", "hidden"])

    pairs = "array<struct<gt_id:int,pred_id:int,iou:double>>"
    return together.mapInArrow(settle, f"clip_id {kind[0]}, frame {kind[1]}, n_gt long, n_pred long, near {pairs}, matched {pairs}, hidden array<int>")


def matches(boxes: DataFrame, threshold: float = 0.5, greedy: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """One-to-one matches per labelled frame: ``clip_id, frame, gt_id, pred_id, iou``."""
    return settled(boxes, threshold, greedy, frames).select("clip_id", "frame", F.inline("matched"))


def suppressed(boxes: DataFrame, threshold: float = 0.5, greedy: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """Predictions on labelled frames (``clip_id, frame, pred_id``) that match nothing scored and lie on an ignored box."""
    return settled(boxes, threshold, greedy, frames).select("clip_id", "frame", F.explode("hidden").alias("pred_id"))


def detection(boxes: DataFrame, threshold: float = 0.5, greedy: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """Per clip: true and false positives, misses, suppressed predictions, precision, recall, F1 and mean overlap."""
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["iou"])
    counts = settled(boxes, threshold, greedy, frames).groupBy("clip_id").agg(
        F.sum(F.size("matched")).alias("tp"), F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum(F.size("hidden")).alias("suppressed"), F.sum(total("matched")).alias("iou")
    )
    mean = F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(F.lit(0.0))
    joined = counts.select("clip_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), "suppressed", mean.alias("mean_iou"))
    return joined.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def _followed(frames: list[dict], greedy: bool) -> tuple:
    """MOTA, MOTP, switches and counts over a clip's frames in order."""
    last: dict[int, int] = {}
    tp = n_gt = n_pred = switches = 0
    overlaps = 0.0
    for now in frames:
        near = {(p["gt_id"], p["pred_id"]): p["iou"] for p in now["near"]}
        held: dict[int, int] = {}
        used: set[int] = set()
        if any(last.get(g) == p for g, p in near):
            for g, p in last.items():  # in the order in which objects were first matched
                if (g, p) in near and p not in used:
                    held[g] = p
                    used.add(p)
        for g, p, _ in _solved([(g, p, v) for (g, p), v in near.items() if g not in held and p not in used], greedy):
            switches += last.get(g, p) != p
            held[g] = p
        overlaps += sum(near[x] for x in held.items())
        last |= held
        tp, n_gt, n_pred = tp + len(held), n_gt + now["n_gt"], n_pred + now["n_pred"]
    fp, fn = n_pred - tp, n_gt - tp
    return (1 - (fn + fp + switches) / n_gt if n_gt else 0.0, overlaps / tp if tp else 0.0, switches, tp, fp, fn)


def clear_mot(boxes: DataFrame, threshold: float = 0.5, greedy: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """Per clip: MOTA, MOTP, identity switches and counts. An object keeps the prediction it had last while they overlap enough."""
    kind = boxes.schema["clip_id"].dataType.simpleString()
    rows = settled(boxes, threshold, greedy, frames).select("clip_id", F.struct("frame", "n_gt", "n_pred", "near").alias("f"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_followed(clip.as_py(), greedy) for clip in batch.column("f")]
            types = [pa.float64(), pa.float64(), *[pa.int64()] * 4]
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), *columns], ["clip_id", "mota", "motp", "id_switches", "tp", "fp", "fn"])

    clips = rows.groupBy("clip_id").agg(F.array_sort(F.collect_list("f")).alias("f"))  # a clip is a row of the result
    return clips.mapInArrow(follow, f"clip_id {kind}, mota double, motp double, id_switches long, tp long, fp long, fn long")


def cooccurrence(boxes: DataFrame, threshold: float = 0.5, greedy: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """Labelled frames that each ground truth track and each predicted track spend together."""
    pairs = settled(boxes, threshold, greedy, frames).select("clip_id", F.inline("near"))
    return pairs.groupBy("clip_id", "gt_id", "pred_id").agg(F.count(F.lit(1)).alias("frames"))


def idf1(boxes: DataFrame, threshold: float = 0.5, greedy: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """Per clip: one assignment of tracks to tracks that keeps most frames, and IDF1, IDP and IDR from it."""
    kind = boxes.schema["clip_id"].dataType.simpleString()
    # counts of a frame ride along as a pair of no tracks, so that frames are settled once
    none = F.array(F.struct(F.lit(None).cast("int").alias("gt_id"), F.lit(None).cast("int").alias("pred_id"), F.lit(0.0).alias("iou")))
    rows = settled(boxes, threshold, greedy, frames).select("clip_id", "n_gt", "n_pred", F.inline(F.concat("near", none)))
    alone = F.col("gt_id").isNull()
    counted = rows.groupBy("clip_id", "gt_id", "pred_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.when(alone, F.col("n_gt"))).alias("n_gt"), F.sum(F.when(alone, F.col("n_pred"))).alias("n_pred"))
    together = counted.groupBy("clip_id").agg(
        F.max("n_gt").alias("n_gt"), F.max("n_pred").alias("n_pred"), F.array_sort(F.collect_list(F.when(F.col("gt_id").isNotNull(), F.struct("gt_id", "pred_id", "frames")))).alias("pairs")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [int(sum(v for _, _, v in _solved([(p["gt_id"], p["pred_id"], p["frames"]) for p in pairs.as_py()], greedy))) for pairs in batch.column("pairs")]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("n_gt"), batch.column("n_pred"), pa.array(best, pa.int64())], ["clip_id", "n_gt", "n_pred", "idtp"])

    joined = together.mapInArrow(solve, f"clip_id {kind}, n_gt long, n_pred long, idtp long")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return joined.select(
        "clip_id", "idtp", (F.col("n_pred") - F.col("idtp")).alias("idfp"), (F.col("n_gt") - F.col("idtp")).alias("idfn"),
        ratio(2 * F.col("idtp"), F.col("n_gt") + F.col("n_pred")).alias("idf1"), ratio(F.col("idtp"), F.col("n_pred")).alias("idp"), ratio(F.col("idtp"), F.col("n_gt")).alias("idr"),
    )


def grounding(boxes: DataFrame, threshold: float = 0.5, window: int = 30, frames: DataFrame | None = None) -> DataFrame:
    """Per ground truth track: whether and how late a prediction acquired it. Tracks claim in order of their first box; each prediction is
    credited once. The overlap counts on the first frame at or after acquisition where both have a box."""
    from tilespark.operators import clips  # which reads the same settled frames

    declared = None if frames is None else frames.groupBy("clip_id").agg(F.collect_set("frame").alias("frames"))
    found = clips.track_rows(clips.evaluated(boxes, declared, threshold=threshold, window=window))
    return found.select("clip_id", "gt_id", "late_entry", "grounded", F.col("pred_id").cast("long").alias("pred_id"), "latency")


def clip_grounding(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("grounded").alias("grounded"), F.count_if(~F.col("late_entry")).alias("initial_total"), F.count_if(F.col("grounded") & ~F.col("late_entry")).alias("initial_grounded"),
        F.count_if("late_entry").alias("late_total"), F.count_if(F.col("grounded") & F.col("late_entry")).alias("late_grounded"), F.median("latency").alias("median_latency"), F.max("latency").alias("max_latency"),
    )

