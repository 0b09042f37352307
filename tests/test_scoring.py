"""Matching and scoring on cases small enough to count by hand, and against brute force."""

import itertools

import numpy as np
import pytest

from tilespark.operators import matching, scoring, tiled, tiling

BOXES = "clip_id int, side string, track_id int, ignore boolean, acquired_frame int, frame int, x1 double, y1 double, x2 double, y2 double"


def lane(side, track, lane_, frames, shift=0.0, ignore=False, acquired=0):
    return [(1, side, track, ignore, acquired, f, 20.0 * f + shift, 100.0 * lane_, 20.0 * f + shift + 10, 100.0 * lane_ + 10) for f in frames]


def frame(spark, *parts):
    return spark.createDataFrame([r for p in parts for r in p], BOXES)


TRUTH = lane("gt", 1, 0, range(5)) + lane("gt", 2, 1, range(5))


def all_metrics(b):
    return scoring.detection(b).collect()[0], scoring.clear_mot(b).collect()[0], scoring.idf1(b).collect()[0]


def test_perfect(spark):
    d, m, i = all_metrics(frame(spark, TRUTH, lane("pred", 11, 0, range(5)), lane("pred", 12, 1, range(5))))
    assert (d.tp, d.fp, d.fn, d.f1, m.mota, m.id_switches, i.idf1) == (10, 0, 0, 1.0, 1.0, 0, 1.0)


def test_one_box_wrong(spark):
    d, m, i = all_metrics(frame(spark, TRUTH, lane("pred", 11, 0, range(5)), lane("pred", 12, 1, range(4)), lane("pred", 12, 1, [4], 50)))
    assert (d.tp, d.fp, d.fn) == (9, 1, 1) and d.precision == d.recall == pytest.approx(0.9) and d.f1 == pytest.approx(0.9)
    assert m.mota == pytest.approx(0.8) and m.id_switches == 0 and i.idf1 == pytest.approx(0.9)


def test_handover(spark):
    _, m, i = all_metrics(frame(spark, TRUTH, lane("pred", 11, 0, range(3)), lane("pred", 13, 0, range(3, 5)), lane("pred", 12, 1, range(5))))
    assert m.id_switches == 1 and m.mota == pytest.approx(0.9) and i.idtp == 8 and i.idf1 == pytest.approx(0.8)


def test_swap(spark):
    _, m, _ = all_metrics(frame(spark, TRUTH, lane("pred", 11, 0, range(3)), lane("pred", 12, 0, range(3, 5)), lane("pred", 12, 1, range(3)), lane("pred", 11, 1, range(3, 5))))
    assert m.id_switches == 2 and m.mota == pytest.approx(0.8)


def test_switch_counts_across_a_gap(spark):
    _, m, _ = all_metrics(frame(spark, lane("gt", 1, 0, range(6)), lane("pred", 11, 0, range(2)), lane("pred", 12, 0, range(4, 6))))
    assert m.id_switches == 1


def test_association_stays_while_it_overlaps(spark):
    # a second prediction overlaps better later on, but the first still clears the threshold
    b = frame(spark, lane("gt", 1, 0, range(3)), lane("pred", 11, 0, range(3), 2), lane("pred", 12, 0, range(1, 3), 0))
    m = scoring.clear_mot(b).collect()[0]
    assert m.id_switches == 0 and m.fp == 2


def test_ignored_region(spark):
    b = frame(spark, TRUTH, lane("gt", 9, 5, range(5), ignore=True), lane("pred", 11, 0, range(5)), lane("pred", 12, 1, range(5)), lane("pred", 13, 5, range(5)))
    assert scoring.suppressed(b).count() == 5
    d, m, _ = all_metrics(b)
    assert d.fp == 0 and m.mota == 1.0


def test_unlabelled_frames_do_not_count(spark):
    # one object annotated on one frame; predictions go on where nobody looked
    b = frame(spark, lane("gt", 1, 0, [0]), lane("pred", 11, 0, range(3)), lane("pred", 12, 4, [1, 2]))
    d, m, i = all_metrics(b)
    assert (d.tp, d.fp, d.fn) == (1, 0, 0) and (m.fp, m.mota) == (0, 1.0) and (i.idfp, i.idf1) == (0, 1.0)
    # declared frames are exhaustively labelled: what is predicted there counts, also without any truth
    declared = spark.createDataFrame([(1, 0), (1, 1)], "clip_id int, frame int")
    assert scoring.detection(b, frames=declared).collect()[0].fp == 2
    m, i = scoring.clear_mot(b, frames=declared).collect()[0], scoring.idf1(b, frames=declared).collect()[0]
    assert (m.fp, m.mota, i.idfp) == (2, -1.0, 2)
    # and fewer frames than were annotated
    whole = frame(spark, lane("gt", 1, 0, range(5)), lane("pred", 11, 0, range(2)))
    assert scoring.detection(whole, frames=declared).collect()[0].fn == 0 and scoring.detection(whole).collect()[0].fn == 3
    assert scoring.grounding(whole, frames=declared).collect()[0].grounded


def test_clutter_beside_a_match(spark):
    b = frame(spark, TRUTH, lane("pred", 11, 0, range(5), 1), lane("pred", 12, 1, range(5)), lane("pred", 40, 0, [2], 3))
    d, m, i = all_metrics(b)
    assert (d.tp, d.fp, d.fn, m.fp, m.id_switches, i.idfp) == (10, 1, 0, 1, 0, 1)
    assert {(r.gt_id, r.pred_id, r.frames) for r in scoring.cooccurrence(b).collect()} == {(1, 11, 5), (2, 12, 5), (1, 40, 1)}


@pytest.mark.parametrize(("window", "grounded"), [(5, True), (2, False)])
def test_late_acquisition(spark, window, grounded):
    b = frame(spark, lane("gt", 1, 0, range(8)), lane("pred", 11, 0, range(3, 8), acquired=3))
    r = scoring.grounding(b, window=window).collect()[0]
    assert r.grounded is grounded and r.latency == (3 if grounded else None)
    assert scoring.clip_grounding(scoring.grounding(b, window=window)).collect()[0].grounded == int(grounded)


def test_each_prediction_is_credited_once(spark):
    b = frame(spark, lane("gt", 1, 0, range(5)), lane("gt", 2, 0, range(1, 5), 1), lane("pred", 11, 0, range(5)))
    assert {r.gt_id: r.grounded for r in scoring.grounding(b).collect()} == {1: True, 2: False}


def test_assignment_takes_the_largest_total():
    assert matching.assign(np.array([[0.9, 0.6], [0.85, 0.0]])) == [(0, 1), (1, 0)]
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        for _ in range(10):
            g = np.round(rng.random((n, m)), 2)
            best = max(sum(g[i, j] for i, j in zip(rows, cols)) for rows in itertools.permutations(range(n), min(n, m)) for cols in [range(min(n, m))]) if n >= m else max(sum(g[i, c] for i, c in enumerate(cols)) for cols in itertools.permutations(range(m), n))
            got = matching.assign(g)
            assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == min(n, m)
            assert sum(g[i, j] for i, j in got) == pytest.approx(best)


def test_total_overlap_beats_pair_count():
    # one exact pair outweighs two poor ones only if its total is larger
    g = np.array([[1.0, 0.55], [0.55, 0.0]])
    assert matching.assign(g) == [(0, 1), (1, 0)]
    assert matching.greedy_pairs(g, 0.5) == [(0, 0)]


def test_overlap_of_touching_and_empty_boxes():
    a = np.array([[0, 0, 10, 10], [5, 5, 5, 9]], dtype=float)
    assert matching.iou_matrix(a, np.array([[10, 0, 20, 10], [0, 0, 10, 10], [5, 5, 5, 9]], dtype=float)).tolist() == [[0, 1, 0], [0, 0, 0]]


def test_suppression_ranks_by_score_then_area():
    b = np.array([[0, 0, 10, 10], [0, 0, 10, 11], [50, 0, 60, 10]], dtype=float)
    assert matching.survivors(b, np.array([1.0, 1.0, 0.2]), 0.5) == [1, 2]
    assert matching.survivors(b, np.array([1.0, 0.5, 0.2]), 0.5) == [0, 2]


def seen_by_tiles(spark, width, height, targets, tile, overlap):
    """What a perfect detector reports for each tile of a frame."""
    tiles = tiling.frame_tiles(spark.createDataFrame([(1, width, height)], "frame_id long, width int, height int"), tile, overlap).collect()
    rows, plan = [], []
    for k, t in enumerate(tiles):
        plan.append((1, k, t.x0, t.y0, t.x1, t.y1, width, height))
        for a, b, c, d in targets:
            x1, y1, x2, y2 = max(a, t.x0), max(b, t.y0), min(c, t.x1), min(d, t.y1)
            if x2 > x1 and y2 > y1:
                rows.append((1, k, float(x1 - t.x0), float(y1 - t.y0), float(x2 - t.x0), float(y2 - t.y0), 1.0))
    return tiled.in_frame(
        spark.createDataFrame(rows, "frame_id long, tile int, x1 double, y1 double, x2 double, y2 double, score double"),
        spark.createDataFrame(plan, "frame_id long, tile int, x0 int, y0 int, x1 int, y1 int, width int, height int"),
    )


@pytest.mark.parametrize(
    ("size", "targets", "overlap", "stitch", "n"),
    [
        ((896, 448), [(430, 200, 470, 240)], 0.0, True, 1),
        ((896, 448), [(430, 200, 470, 240)], 0.0, False, 2),
        ((896, 448), [(400, 200, 440, 240), (500, 200, 540, 240)], 0.0, True, 2),
        ((1000, 500), [(100, 100, 140, 130), (600, 300, 660, 340)], 0.2, True, 2),
        ((1200, 800), [(300, 390, 900, 430)], 0.2, True, 1),
        ((200, 150), [(10, 10, 60, 50)], 0.2, True, 1),
    ],
)
def test_tiled_detection(spark, size, targets, overlap, stitch, n):
    found = tiled.reconciled(seen_by_tiles(spark, *size, targets, 448, overlap), stitch=stitch).collect()
    assert len(found) == n
    if stitch:
        assert sorted((r.x1, r.y1, r.x2, r.y2) for r in found) == sorted(tuple(map(float, t)) for t in targets)


def test_what_is_known_of_a_detection_rides_along(spark):
    tiles = spark.createDataFrame([(1, k, x, 0, x + 448, 448, 848, 448, f"prompt {k}") for k, x in ((0, 0), (1, 400))], "frame_id long, tile int, x0 int, y0 int, x1 int, y1 int, width int, height int, prompt string")

    def find(tile):
        x1, x2 = max(385, tile["x0"]) - tile["x0"], min(492, tile["x0"] + 448) - tile["x0"]
        return [{"x1": float(x1), "y1": 5.0, "x2": float(x2), "y2": 25.0, "score": 0.5 + tile["tile"] / 10, "said": tile["prompt"]}]

    hits = tiled.detected(tiles, find, "x1 double, y1 double, x2 double, y2 double, score double, said string")
    found = tiled.in_frame(hits, tiles.drop("prompt"))
    assert {(r.said, r.x1, r.x2) for r in found.collect()} == {("prompt 0", 385.0, 448.0), ("prompt 1", 400.0, 492.0)}
    assert [(r.x1, r.x2, r.said) for r in tiled.reconciled(found).collect()] == [(385.0, 492.0, "prompt 1")]
    assert {r.said for r in tiled.suppressed(found).collect()} == {"prompt 0", "prompt 1"}
