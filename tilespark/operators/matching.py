"""Matching of boxes: assignment, suppression of duplicates, stitching; pure NumPy, called for one group at a time."""

from __future__ import annotations

import numpy as np


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box in ``a`` with every box in ``b`` (rows of x1, y1, x2, y2)."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:4], b[None, :, 2:4])
    both = np.clip(high - low, 0, None).prod(2)
    area = lambda x: np.clip(x[:, 2:4] - x[:, :2], 0, None).prod(1)
    either = area(a)[:, None] + area(b)[None, :] - both
    return np.divide(both, either, out=np.zeros_like(both), where=either > 0)


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), each used once, of the largest total gain; gains are not negative.

    Rows enter one after the other; each is brought in along the path of least loss, found with prices that keep all losses non-negative.
    """
    if not gain.size:
        return []
    if gain.shape[0] > gain.shape[1]:
        return sorted((i, j) for j, i in assign(gain.T))
    loss = gain.max() - gain
    n, m = loss.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        reach, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, column, spent = start, -1, 0.0
        while True:
            through = spent + loss[row] - row_price[row] - column_price
            better = ~done & (through < reach - 1e-15)
            reach[better], came[better] = through[better], column
            open_columns = np.where(done, np.inf, reach)
            column = int(open_columns.argmin())
            spent = open_columns[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = int(row_of[column])
        inside = done.copy()
        inside[column] = False
        row_price[start] += spent
        row_price[row_of[inside]] += spent - reach[inside]
        column_price[inside] -= spent - reach[inside]
        while column >= 0:
            before = int(came[column])
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    return sorted((int(r), j) for j, r in enumerate(row_of.tolist()) if r >= 0)


def match(a: np.ndarray, b: np.ndarray, threshold: float, greedy: bool = False) -> list[tuple[int, int]]:
    """One-to-one pairs with overlap of ``threshold`` or more, of the largest total overlap (or, greedily, the best pair first)."""
    overlap = iou_matrix(a, b)
    if greedy:
        return greedy_pairs(overlap, threshold)
    return [(i, j) for i, j in assign(np.where(overlap >= threshold, overlap, 0.0)) if overlap[i, j] >= threshold]


def greedy_pairs(value: np.ndarray, least: float) -> list[tuple[int, int]]:
    order = np.argsort(-value, axis=None, kind="stable")
    rows, columns, found = set(), set(), []
    for i, j in zip(*np.unravel_index(order, value.shape), strict=True) if value.size else []:
        if value[i, j] < least:
            break
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            found.append((int(i), int(j)))
    return sorted(found)


def survivors(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Greedy non-maximum suppression: indices kept, by score, then area, then order."""
    area = np.clip(boxes[:, 2:4] - boxes[:, :2], 0, None).prod(1)
    todo = np.lexsort((np.arange(len(boxes)), -area, -scores))
    overlap, kept = iou_matrix(boxes, boxes), []
    while len(todo):
        kept.append(int(todo[0]))
        todo = todo[1:][overlap[todo[0], todo[1:]] < threshold]
    return kept


class Detections:
    """Detections of one frame: boxes in frame coordinates, scores, the tile and cut sides (left, top, right, bottom) of each."""

    def __init__(self, boxes: np.ndarray, scores: np.ndarray, tiles: np.ndarray, seams: np.ndarray, source: np.ndarray | None = None):
        self.boxes, self.scores, self.tiles, self.seams = boxes.astype(float), scores.astype(float), tiles, seams.astype(bool)
        #: The row each comes from: whatever else is known of it rides along.
        self.source = np.arange(len(boxes)) if source is None else source

    def take(self, keep) -> Detections:
        return Detections(self.boxes[keep], self.scores[keep], self.tiles[keep], self.seams[keep], self.source[keep])

    def continues(self, margin: float) -> np.ndarray:
        """continues[i, j]: j carries on what a seam cut off i."""
        b, n = self.boxes, len(self.boxes)
        found = np.zeros((n, n), dtype=bool)
        for axis in (0, 1):
            low, high, low2, high2 = b[:, axis], b[:, axis + 2], b[:, 1 - axis], b[:, 3 - axis]
            facing = self.seams[:, axis + 2][:, None] & self.seams[:, axis][None, :]
            onward = (low[:, None] <= low[None, :]) & (high[:, None] <= high[None, :])
            close = low[None, :] - high[:, None] <= margin
            shared = np.minimum(high2[:, None], high2[None, :]) - np.maximum(low2[:, None], low2[None, :])
            shorter = np.minimum((high2 - low2)[:, None], (high2 - low2)[None, :])
            beside = np.divide(shared, shorter, out=np.zeros((n, n)), where=shorter > 0) >= 0.5
            found |= facing & onward & close & beside
        return found & (self.tiles[:, None] != self.tiles[None, :])

    def stitched(self, margin: float) -> Detections:
        """Unites the first pair of fragments again and again until there is none."""
        now = self
        while len(now.boxes) > 1:
            on = now.continues(margin)
            pairs = np.argwhere(np.triu(on | on.T, 1))
            if not len(pairs):
                break
            i, j = pairs[0].tolist()
            first, second = (i, j) if on[i, j] else (j, i)
            box = np.concatenate([np.minimum(now.boxes[i, :2], now.boxes[j, :2]), np.maximum(now.boxes[i, 2:], now.boxes[j, 2:])])
            lead = first if now.scores[first] >= now.scores[second] else second
            still = (now.seams[i] & (now.boxes[i] == box)) | (now.seams[j] & (now.boxes[j] == box))
            united = Detections(now.boxes.copy(), now.scores.copy(), now.tiles.copy(), now.seams.copy(), now.source.copy())
            united.boxes[i], united.scores[i], united.tiles[i], united.seams[i], united.source[i] = box, now.scores[lead], now.tiles[lead], still, now.source[lead]
            now = united.take(np.arange(len(now.boxes)) != j)
        return now

    def without_seam_duplicates(self, contained: float) -> Detections:
        """Drops boxes cut by a seam that a larger box of another tile covers by ``contained`` or more."""
        b = self.boxes
        if not len(b):
            return self
        area = np.clip(b[:, 2:] - b[:, :2], 0, None).prod(1)
        both = np.clip(np.minimum(b[:, None, 2:], b[None, :, 2:]) - np.maximum(b[:, None, :2], b[None, :, :2]), 0, None).prod(2)
        share = np.divide(both, area[:, None], out=np.zeros_like(both), where=area[:, None] > 0)
        seen = (self.tiles[:, None] != self.tiles[None, :]) & (area[None, :] > area[:, None]) & (share >= contained)
        return self.take(~(self.seams.any(1) & seen.any(1)))
