"""Whole scores of clips: a row for every clip that was declared, with or without targets, tracks or boxes.

A clip table has ``clip_id`` and ``frames`` (labelled frames, null where nobody declared them: then every frame with ground truth counts). Boxes are rows as in
:mod:`tilespark.operators.scoring`; a track table (``clip_id, side, track_id, label, ignore, acquired_frame``) names tracks, also those without boxes. Boxes are read
once: a frame's boxes are settled together, a clip's frames, header and tracks meet in one row (a clip is a row of the result), and all metrics are read
from it, with the assignment of tracks to tracks as rows beside its totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.operators.matching import iou_matrix
from tilespark.operators.scoring import XY, _followed, _solved

_PAIR = "struct<gt_id: int, pred_id: int, iou: double>"
_FRAME = f"frame: int, has_gt: boolean, n_gt: long, n_pred: long, near: array<{_PAIR}>, over: array<{_PAIR}>, tp: long, iou: double, hidden: long, gt: array<int>, ignored: array<int>, pred: array<struct<id: int, acquired: int>>"
_PAIRS = pa.list_(pa.struct([("gt_id", pa.int32()), ("pred_id", pa.int32()), ("iou", pa.float64())]))
_PREDICTED = pa.list_(pa.struct([("id", pa.int32()), ("acquired", pa.int32())]))
_FRAME_ARROW = pa.struct([("frame", pa.int32()), ("has_gt", pa.bool_()), *[(c, pa.int64()) for c in ("n_gt", "n_pred")], ("near", _PAIRS), ("over", _PAIRS), ("tp", pa.int64()), ("iou", pa.float64()), ("hidden", pa.int64()), ("gt", pa.list_(pa.int32())), ("ignored", pa.list_(pa.int32())), ("pred", _PREDICTED)])

COUNTS = ["labeled_frames", "gt_tracks", "ignore_tracks", "gt_boxes", "pred_tracks", "pred_boxes", "pred_boxes_suppressed", "tp", "fp", "fn", "mot_tp", "mot_fp", "mot_fn", "id_switches", "idtp", "idfp", "idfn", "total", "grounded", "initial_total", "initial_grounded", "late_total", "late_grounded"]
RATIOS = ["precision", "recall", "f1", "mean_iou", "mota", "motp", "idf1", "idp", "idr"]
_TRACK = [("gt_id", "int"), ("label", "string"), ("boxes", "long"), ("late_entry", "boolean"), ("grounded", "boolean"), ("pred_id", "int"), ("latency", "long"), ("match_id", "int"), ("idtp", "long")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_TRACKS_ARROW = pa.list_(pa.struct([(c, _ARROW[k]) for c, k in _TRACK]))


def _settled(boxes: DataFrame, threshold: float, ground: float, greedy: bool) -> DataFrame:
    """``clip_id, f`` of each frame with boxes: counts, overlaps and who is there."""
    one = F.struct((F.col("side") == "gt").alias("gt"), F.coalesce("ignore", F.lit(False)).alias("ignore"), F.col("track_id").cast("int").alias("id"), F.col("acquired_frame").cast("int").alias("acquired"), *[F.col(c).cast("double").alias(c) for c in XY])
    together = boxes.groupBy("clip_id", F.col("frame").cast("int").alias("frame")).agg(F.array_sort(F.collect_list(one)).alias("b"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch["b"], []
            flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
            is_gt, ignored, ids, acquired = (pc.fill_null(flat.field(c), z).to_numpy(zero_copy_only=False) for c, z in (("gt", False), ("ignore", False), ("id", 0), ("acquired", 0)))
            xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in XY], axis=1) if len(flat) else np.zeros((0, 4))
            named = lambda some: [dict(zip(("gt_id", "pred_id", "iou"), p, strict=True)) for p in some]
            for frame, lo, hi in zip(batch["frame"].to_pylist(), cuts[:-1], cuts[1:], strict=True):
                gt, pred = lo + np.flatnonzero(is_gt[lo:hi]), lo + np.flatnonzero(~is_gt[lo:hi])
                overlap, aside = iou_matrix(xy[gt], xy[pred]), ignored[gt]
                g_ids, p_ids = ids[gt].tolist(), ids[pred].tolist()
                rows, columns = np.nonzero(overlap >= min(threshold, ground))
                pairs = [(g_ids[i], p_ids[j], float(overlap[i, j]), bool(aside[i])) for i, j in zip(rows.tolist(), columns.tolist(), strict=True)]
                scored = [p[:3] for p in pairs if not p[3]]
                matched = _solved([p for p in scored if p[2] >= threshold], greedy)
                hidden = {p[1] for p in pairs if p[3] and p[2] >= threshold} - {p[1] for p in matched}
                out.append({
                    "frame": frame, "has_gt": len(gt) > 0, "n_gt": int((~aside).sum()), "n_pred": len(pred) - len(hidden), "near": named(p for p in scored if p[2] >= threshold and p[1] not in hidden),
                    "over": named(p for p in scored if p[2] >= ground), "tp": len(matched), "iou": sum(p[2] for p in matched), "hidden": len(hidden), "gt": [g for g, x in zip(g_ids, aside, strict=True) if not x],
                    "ignored": [g for g, x in zip(g_ids, aside, strict=True) if x], "pred": [{"id": p, "acquired": q} for p, q in zip(p_ids, acquired[pred].tolist(), strict=True)],
                })
            yield pa.RecordBatch.from_arrays([batch["clip_id"], pa.array(out, _FRAME_ARROW)], ["clip_id", "f"])

    return together.mapInArrow(settle, f"clip_id {boxes.schema['clip_id'].dataType.simpleString()}, f struct<{_FRAME}>")


def _grounded(tracks: list[dict], frames: list[dict], labelled: set, acquired: dict[int, int], window: int) -> list[dict]:
    """Ground truth tracks in the order of their first boxes, each with the free prediction that overlaps it best where both are first seen."""
    on: dict[int, list[dict]] = {}
    offers: dict[int, set[int]] = {}
    for f in frames:
        if f["frame"] in labelled:
            for g in f["gt"]:
                on.setdefault(g, []).append(f)
            for p in f["over"]:
                offers.setdefault(p["gt_id"], set()).add(p["pred_id"])
    present = {f["frame"]: {p["id"] for p in f["pred"]} for f in frames}
    overlap = {f["frame"]: {(p["gt_id"], p["pred_id"]): p["iou"] for p in f["over"]} for f in frames}
    out, taken = [], set()
    for t in tracks:
        g, own = t["id"], on.get(t["id"], [])
        first = own[0]["frame"] if own else None
        best = None
        for p in sorted(offers.get(g, ())):
            if p in taken or acquired[p] > first + window:
                continue
            check = next((f["frame"] for f in own if f["frame"] >= acquired[p] and p in present[f["frame"]]), None)
            value = None if check is None else overlap[check].get((g, p))
            if value is not None and (best is None or value > best[0]):
                best = (value, p)
        if best:
            taken.add(best[1])
        out.append({"gt_id": g, "label": t["label"] or "", "boxes": len(own), "late_entry": first is not None and first > window, "grounded": best is not None, "pred_id": best and best[1], "latency": best and max(0, acquired[best[1]] - first)})
    return out


def _clip(declared: list[int] | None, frames: list[dict], named: list[dict], window: int, greedy: bool) -> dict:
    frames = sorted(frames, key=lambda f: f["frame"])
    labelled = set(declared or [f["frame"] for f in frames if f["has_gt"]])
    inside = [f for f in frames if f["frame"] in labelled]
    first: dict[int, int] = {}
    label = {(t["side"], t["track_id"]): t["label"] for t in named}
    acquired = {t["track_id"]: t["acquired_frame"] for t in named if t["side"] == "pred"}
    ignored = {t["track_id"] for t in named if t["side"] == "gt" and t["ignore"]}
    for t in named:
        if t["side"] == "gt" and not t["ignore"]:
            first.setdefault(t["track_id"], 1 << 40)  # without boxes: set to 0 below
    for f in frames:
        for g in f["gt"]:
            first[g] = min(first.get(g, 1 << 40), f["frame"])
        ignored.update(f["ignored"])
        for p in f["pred"]:
            acquired[p["id"]] = min(acquired.get(p["id"], 1 << 40), p["acquired"] or 0)
    order = sorted((0 if at == 1 << 40 else at, g) for g, at in first.items())
    tracks = _grounded([{"id": g, "label": label.get(("gt", g), "")} for _, g in order], frames, labelled, acquired, window)
    mota, motp, switches, mot_tp, mot_fp, mot_fn = _followed(inside, greedy)
    tp, n_gt, n_pred = (sum(f[c] for f in inside) for c in ("tp", "n_gt", "n_pred"))
    together: dict[tuple[int, int], int] = {}
    for f in inside:
        for p in f["near"]:
            together[p["gt_id"], p["pred_id"]] = together.get((p["gt_id"], p["pred_id"]), 0) + 1
    pairs = {g: (p, int(n)) for g, p, n in _solved([(g, p, n) for (g, p), n in sorted(together.items())], greedy)}
    idtp = sum(n for _, n in pairs.values())
    for t in tracks:
        t["match_id"], t["idtp"] = pairs.get(t["gt_id"], (None, 0))
    ratio = lambda a, b: a / b if b else 0.0
    late, start = [t for t in tracks if t["late_entry"]], [t for t in tracks if not t["late_entry"]]
    latencies = [t["latency"] for t in tracks if t["grounded"]]
    return {
        "labeled_frames": len(labelled), "gt_tracks": len(tracks), "ignore_tracks": len(ignored), "gt_boxes": n_gt, "pred_tracks": len(acquired), "pred_boxes": n_pred, "pred_boxes_suppressed": sum(f["hidden"] for f in inside),
        "tp": tp, "fp": n_pred - tp, "fn": n_gt - tp, "mot_tp": mot_tp, "mot_fp": mot_fp, "mot_fn": mot_fn, "id_switches": switches, "idtp": idtp, "idfp": n_pred - idtp, "idfn": n_gt - idtp,
        "total": len(tracks), "grounded": len(latencies), "initial_total": len(start), "initial_grounded": sum(t["grounded"] for t in start), "late_total": len(late), "late_grounded": sum(t["grounded"] for t in late),
        "precision": ratio(tp, n_pred), "recall": ratio(tp, n_gt), "f1": ratio(2.0 * tp, n_pred + n_gt), "mean_iou": ratio(sum(f["iou"] for f in inside), tp), "mota": mota, "motp": motp,
        "idf1": ratio(2 * idtp, n_gt + n_pred), "idp": ratio(idtp, n_pred), "idr": ratio(idtp, n_gt), "median_latency": float(median(latencies)) if latencies else None, "max_latency": max(latencies, default=None), "per_track": tracks,
    }


def evaluated(boxes: DataFrame, clips: DataFrame | None = None, tracks: DataFrame | None = None, threshold: float = 0.5, ground: float | None = None, window: int = 30, greedy: bool = False) -> DataFrame:
    """A row of each clip that is declared or has boxes or tracks: counts, ratios, latencies (null without any) and ``per_track``."""
    kind = boxes.schema["clip_id"].dataType.simpleString()
    rows = _settled(boxes, threshold, threshold if ground is None else ground, greedy).withColumn("declared", F.lit(None).cast("array<int>")).withColumn("t", F.lit(None).cast("struct<side: string, track_id: int, label: string, ignore: boolean, acquired_frame: int>"))
    if clips is not None:
        rows = rows.unionByName(clips.select(F.col("clip_id").cast(kind).alias("clip_id"), F.col("frames").cast("array<int>").alias("declared")), allowMissingColumns=True)
    if tracks is not None:
        t = F.struct("side", F.col("track_id").cast("int").alias("track_id"), "label", F.coalesce("ignore", F.lit(False)).alias("ignore"), F.coalesce(F.col("acquired_frame").cast("int"), F.lit(0)).alias("acquired_frame"))
        rows = rows.unionByName(tracks.select(F.col("clip_id").cast(kind).alias("clip_id"), t.alias("t")), allowMissingColumns=True)
    whole = rows.groupBy("clip_id").agg(F.first("declared", ignorenulls=True).alias("declared"), F.collect_list("f").alias("f"), F.collect_list("t").alias("t"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_clip(d, f, t, window, greedy) for d, f, t in zip(*(batch[c].to_pylist() for c in ("declared", "f", "t")), strict=True)]
            types = [*[(c, pa.int64()) for c in COUNTS], *[(c, pa.float64()) for c in RATIOS], ("median_latency", pa.float64()), ("max_latency", pa.int64()), ("per_track", _TRACKS_ARROW)]
            yield pa.RecordBatch.from_arrays([batch["clip_id"], *[pa.array([o[c] for o in out], k) for c, k in types]], ["clip_id", *[c for c, _ in types]])

    schema = ", ".join([f"clip_id {kind}", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in RATIOS], "median_latency double", "max_latency long", f"per_track array<struct<{', '.join(f'{c}: {k}' for c, k in _TRACK)}>>"])
    return whole.mapInArrow(score, schema)


def track_rows(scores: DataFrame) -> DataFrame:
    """A row of each scored ground truth track."""
    return scores.select("clip_id", F.inline("per_track"))


def pooled(scores: DataFrame) -> DataFrame:
    """Over all clips, negative ones too: grounding pooled over targets, MOTA and IDF1 averaged, false positives on clips without targets."""
    share = F.when(F.sum("total") > 0, F.sum("grounded") / F.sum("total")).otherwise(F.lit(0.0))
    return scores.agg(F.count(F.lit(1)).alias("clips"), F.count_if(F.col("gt_boxes") == 0).alias("negative_clips"), share.alias("recall"), F.avg("mota").alias("mota"), F.avg("idf1").alias("idf1"), F.coalesce(F.sum(F.when(F.col("gt_boxes") == 0, F.col("fp"))), F.lit(0)).alias("negative_fp"))


def _frames_and_seconds(frames: Column, fps: Column) -> Column:
    """``12 fr (1.2s)``; without the seconds where the rate is unknown, a dash where there are no frames."""
    whole = F.regexp_replace(F.format_string("%.1f", frames.cast("double")), r"\.0$", "")
    seconds = F.when(F.coalesce(fps, F.lit(0.0)) > 0, F.format_string(" (%.1fs)", F.bround(frames / fps, 1))).otherwise("")
    return F.when(frames.isNull(), "-").otherwise(F.concat(whole, F.lit(" fr"), seconds))


def sheet(scores: DataFrame, clips: DataFrame | None = None, threshold: float = 0.5, window: int = 30) -> DataFrame:
    """``clip_id, sheet``: what a person reads of a clip. ``clips`` may bring ``query`` and ``fps``."""
    if clips is None:
        known = scores.withColumns({"query": F.lit(""), "fps": F.lit(0.0)})
    else:
        header = clips.select(F.col("clip_id").alias("_clip"), *[F.col(c) if c in clips.columns else F.lit(None).cast(k).alias(c) for c, k in (("query", "string"), ("fps", "double"))])
        known = scores.join(header, F.col("clip_id").eqNullSafe(F.col("_clip")), "left").withColumn("query", F.coalesce("query", F.lit("")))
    three = lambda *names: [F.bround(c, 3) for c in names]
    share = lambda a, b: F.when(F.col(b) > 0, F.format_string("%d/%d", a, b)).otherwise("n/a")
    only = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, c)).otherwise("")
    track = lambda t: F.format_string(
        "  %3d  %-22s %5d %6s %8s %12s %5s %5d",
        t["gt_id"], F.substring(t["label"], 1, 22), t["boxes"], F.when(t["late_entry"], "late").otherwise("start"), F.when(t["grounded"], "yes").otherwise("NO"),
        _frames_and_seconds(t["latency"], F.col("fps")), F.when(t["match_id"].isNull(), "-").otherwise(F.concat(F.lit("#"), t["match_id"].cast("string"))), t["idtp"],
    )
    lines = [
        F.format_string("clip %s   query '%s'", F.col("clip_id").cast("string"), "query"),
        F.concat(F.format_string("  gt    %d tracks / %d boxes over %d labeled frames", "gt_tracks", "gt_boxes", "labeled_frames"), only("ignore_tracks", " (+%d ignore)")),
        F.concat(F.format_string("  pred  %d tracks / %d boxes on those frames", "pred_tracks", "pred_boxes"), only("pred_boxes_suppressed", " (%d dropped on ignore regions)")),
        F.when(F.col("gt_boxes") == 0, "  note  no targets labeled: only false positives mean anything"),
        F.format_string("grounding @ %.2f within %d frames", F.lit(threshold), F.lit(window)),
        F.format_string("  recall %.3f   %d/%d targets", F.bround(F.when(F.col("total") > 0, F.col("grounded") / F.col("total")).otherwise(F.lit(0.0)), 3), "grounded", "total"),
        F.concat(F.lit("  at start "), share("initial_grounded", "initial_total"), F.lit("   later "), share("late_grounded", "late_total")),
        F.concat(F.lit("  latency median "), _frames_and_seconds(F.col("median_latency"), F.col("fps")), F.lit("   worst "), _frames_and_seconds(F.col("max_latency"), F.col("fps"))),
        F.format_string("detection   precision %.3f   recall %.3f   f1 %.3f   tp %d   fp %d   fn %d   mean IoU %.3f", *three("precision", "recall", "f1"), "tp", "fp", "fn", *three("mean_iou")),
        F.format_string("tracking   MOTA %.3f (fp %d + fn %d + idsw %d over %d boxes)   MOTP %.3f", *three("mota"), "mot_fp", "mot_fn", "id_switches", "gt_boxes", *three("motp")),
        F.format_string("  IDF1 %.3f   idtp %d   idfp %d   idfn %d", *three("idf1"), "idtp", "idfp", "idfn"),
        F.when(F.size("per_track") > 0, F.concat(F.format_string("  %3s  %-22s %5s %6s %8s %12s %5s %5s\n", *[F.lit(x) for x in ("id", "label", "boxes", "entry", "grounded", "latency", "pred", "idtp")]), F.array_join(F.transform("per_track", track), "\n"))),
    ]
    return known.select("clip_id", F.concat_ws("\n", *lines).alias("sheet"))
