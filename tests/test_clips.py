"""Clips from their files to the whole report: declared frames, clips without targets, tracks without boxes."""

import json

import pytest

from tilespark.operators import clips, scoring
from tilespark.sources import corpus


def boxes(lane, frames, shift=0.0):
    return {str(f): [20.0 * f + shift, 100.0 * lane, 20.0 * f + shift + 10, 100.0 * lane + 10] for f in frames}


def written(folder, name, meta, tracks):
    (folder / f"{name}.json").write_text(json.dumps({"meta": meta, "tracks": tracks}, indent=1))


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    gt, pred = (tmp_path_factory.mktemp(side) for side in ("gt", "pred"))
    written(gt, "a", {"clip_id": "a", "fps": 10, "query": "red car", "num_frames": 50, "labeled_frames": [0, 1, 2, 3, 4, 4]}, [
        {"id": 1, "label": "car", "boxes": boxes(0, range(5))}, {"id": 2, "label": "a very long label of a truck", "boxes": boxes(1, range(2, 9))},
        {"id": 3, "label": "never seen", "boxes": {}}, {"id": 9, "ignore": True, "boxes": boxes(5, range(5))},
    ])
    written(pred, "a", {"clip_id": "a"}, [{"id": 11, "acquired_frame": 2, "boxes": boxes(0, range(5), 1)}, {"id": 12, "boxes": boxes(1, range(3, 9))}, {"id": 13, "boxes": boxes(5, range(5))}, {"id": 14, "boxes": boxes(7, [30])}])
    written(gt, "none", {"clip_id": "none", "labeled_frames": [0, 1, 2]}, [])
    written(pred, "none", {"clip_id": "none"}, [{"id": 1, "boxes": boxes(0, range(5))}])
    written(gt, "silent", {"clip_id": "silent"}, [{"id": 1, "boxes": boxes(0, range(3))}])
    written(pred, "silent", {"clip_id": "silent"}, [])
    written(gt, "empty", {}, [])
    b = corpus.read_clips(spark, f"file://{gt}", "gt").unionByName(corpus.read_clips(spark, f"file://{pred}", "pred"))
    t = corpus.read_clip_tracks(spark, f"file://{gt}", "gt").unionByName(corpus.read_clip_tracks(spark, f"file://{pred}", "pred"))
    return corpus.read_clip_table(spark, f"file://{gt}"), b, t


def test_every_clip_has_its_row(read):
    table, b, t = read
    assert {(r.clip_id, tuple(r.frames or ())) for r in table.collect()} == {("a", (0, 1, 2, 3, 4)), ("none", (0, 1, 2)), ("silent", ()), ("empty.json", ())}
    got = {r.clip_id: r for r in clips.evaluated(b, table, t).collect()}
    a = got["a"]
    assert (a.labeled_frames, a.gt_tracks, a.ignore_tracks, a.gt_boxes, a.pred_tracks, a.pred_boxes, a.pred_boxes_suppressed) == (5, 3, 1, 8, 4, 7, 5)
    assert (a.tp, a.fp, a.fn, a.id_switches, a.idtp, a.idfp, a.idfn) == (7, 0, 1, 0, 7, 0, 1)
    assert (a.total, a.grounded, a.late_total, a.median_latency, a.max_latency) == (3, 2, 0, 1.5, 2)
    none = got["none"]
    assert (none.labeled_frames, none.gt_tracks, none.tp, none.fp, none.fn, none.mota, none.idf1, none.median_latency, none.per_track) == (3, 0, 0, 3, 0, 0.0, 0.0, None, [])
    silent = got["silent"]
    assert (silent.labeled_frames, silent.fn, silent.mota, silent.total, silent.grounded, silent.pred_tracks) == (3, 3, 0.0, 1, 0, 0)
    empty = got["empty.json"]
    assert sum(empty[c] for c in clips.COUNTS) == 0 and sum(empty[c] for c in clips.RATIOS) == 0


def test_tracks_and_pooling(read):
    table, b, t = read
    scores = clips.evaluated(b, table, t)
    rows = {(r.clip_id, r.gt_id): tuple(r)[2:] for r in clips.track_rows(scores).collect()}
    assert rows["a", 1] == ("car", 5, False, True, 11, 2, 11, 5)
    assert rows["a", 2] == ("a very long label of a truck", 3, False, True, 12, 1, 12, 2)
    assert rows["a", 3] == ("never seen", 0, False, False, None, None, None, 0)
    p = clips.pooled(scores).collect()[0]
    assert (p.clips, p.negative_clips, p.negative_fp) == (4, 2, 3) and p.recall == pytest.approx(2 / 4) and p.mota == pytest.approx((7 / 8) / 4)


def test_the_sheet(read):
    table, b, t = read
    got = {r.clip_id: r.sheet.split("\n") for r in clips.sheet(clips.evaluated(b, table, t), table).collect()}
    assert got["a"] == [
        "clip a   query 'red car'",
        "  gt    3 tracks / 8 boxes over 5 labeled frames (+1 ignore)",
        "  pred  4 tracks / 7 boxes on those frames (5 dropped on ignore regions)",
        "grounding @ 0.50 within 30 frames",
        "  recall 0.667   2/3 targets",
        "  at start 2/3   later n/a",
        "  latency median 1.5 fr (0.2s)   worst 2 fr (0.2s)",
        "detection   precision 1.000   recall 0.875   f1 0.933   tp 7   fp 0   fn 1   mean IoU 0.870",
        "tracking   MOTA 0.875 (fp 0 + fn 1 + idsw 0 over 8 boxes)   MOTP 0.870",
        "  IDF1 0.933   idtp 7   idfp 0   idfn 1",
        "   id  label                  boxes  entry grounded      latency  pred  idtp",
        "    1  car                        5  start      yes  2 fr (0.2s)   #11     5",
        "    3  never seen                 0  start       NO            -     -     0",
        "    2  a very long label of a     3  start      yes  1 fr (0.1s)   #12     2",
    ]
    assert "  note  no targets labeled: only false positives mean anything" in got["none"] and len(got["none"]) == 11
    assert "  latency median -   worst -" in got["silent"]


def test_all_ways_agree(read):
    _, b, _ = read
    one = {r.clip_id: r for r in clips.evaluated(b).collect()}
    for r in scoring.detection(b).collect():
        assert (r.tp, r.fp, r.fn, r.suppressed) == (one[r.clip_id].tp, one[r.clip_id].fp, one[r.clip_id].fn, one[r.clip_id].pred_boxes_suppressed)
    for r in scoring.idf1(b).collect():
        assert (r.idtp, r.idf1) == (one[r.clip_id].idtp, one[r.clip_id].idf1)
    for r in scoring.clear_mot(b).collect():
        assert (r.mota, r.id_switches) == (one[r.clip_id].mota, one[r.clip_id].id_switches)
    assert {r.clip_id for r in scoring.grounding(b).collect()} == {"a", "silent"}
