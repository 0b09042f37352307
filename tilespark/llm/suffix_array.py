"""Suffix arrays by two-stage sorting, vectorised, exact to a given depth."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0xA24BAED4963EE407)
_BASE_INVERSE = U(pow(0xA24BAED4963EE407, -1, 2**64))


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For every suffix whether it is smaller than the suffix after it; the last one is larger than nothing, so it is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    if not len(change):
        return np.zeros(n, dtype=bool)
    rises = text[change + 1] > text[change]
    run = np.searchsorted(change, np.arange(n), side="left")
    out = np.zeros(n, dtype=bool)
    inside = run < len(change)
    out[inside] = rises[run[inside]]
    return out


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as a number that sorts like them (zeros behind the end)."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    k = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        k = (k << U(8)) | padded[i : i + len(text)].astype(np.uint64)
    return k


def _prefix_hashes(text: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the ``depth`` bytes from every place."""
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)]).astype(np.uint64) + U(1)
    up = np.full(len(padded), _BASE, dtype=np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(padded * up, dtype=np.uint64)])
    down = np.full(len(text), _BASE_INVERSE, dtype=np.uint64)
    down[0] = 1
    return (sums[depth : depth + len(text)] - sums[: len(text)]) * np.multiply.accumulate(down)


def _uneven(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each group (numbered from 0, its members adjacent) holds different values."""
    n = np.bincount(group)
    return np.bincount(group[values != values[np.cumsum(n) - n][group]], minlength=len(n)) > 0


def sort_directly(text: np.ndarray, at: np.ndarray, depth: int, eights: np.ndarray) -> np.ndarray:
    """``at`` ordered by the first ``depth`` bytes of their suffixes, at least.

    Sorted by eight bytes; groups of equals go on with the following bytes, eight at a time. Hashes tell beforehand which groups differ
    within the next 32 bytes, and which differ within the depth at all; the others are passed over.
    """
    order = at[np.argsort(eights[at])].astype(np.int64)
    if len(order) < 2:
        return order.astype(np.int32)
    whole, stride = _prefix_hashes(text, depth), _prefix_hashes(text, 32)
    last = len(text) - 1
    keys = eights[order]
    opens = np.concatenate([[True], keys[1:] != keys[:-1]])
    todo = np.arange(len(order))
    for block in range(8, depth, 32):
        group = np.cumsum(opens) - 1
        keep = _uneven(whole[order[todo]], group)[group]
        todo, opens, group = todo[keep], opens[keep], group[keep]
        if not len(todo):
            break
        group = np.cumsum(opens) - 1
        # behind the end all hashes agree with those at the end, which differ from any other place's
        part = np.flatnonzero(_uneven(stride[np.minimum(order[todo] + block, last)], group)[group])
        places, starts = order[todo[part]], opens[part]
        for done in range(block, min(block + 32, depth), 8):
            if not len(part):
                break
            inner = np.cumsum(starts) - 1
            k = np.where(places + done <= last, eights[np.minimum(places + done, last)], U(0))
            some = np.flatnonzero(_uneven(k, inner)[inner])
            if not len(some):
                continue
            by = np.lexsort((k[some], inner[some]))
            places[some] = places[some][by]
            k[some] = k[some][by]
            starts[1:] |= k[1:] != k[:-1]
        order[todo[part]] = places
        opens[part] = starts
    return order.astype(np.int32)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` (bytes) in the order of their first ``depth`` bytes at least.

    Suffixes smaller than their successors are sorted directly. The others are induced by one scan over the buckets of first bytes: the
    suffix before each one that the scan passes joins the front of its own bucket if its first byte is not smaller.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int32)
    eights = _eights(text)
    small = smaller_than_next(text)
    direct = sort_directly(text, np.flatnonzero(small).astype(np.int32), depth, eights)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1], dtype=np.int32))
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int32)
        waiting[c] = []
        bucket = [front]
        while len(front):  # runs of the byte itself, one step at a time
            before = front[front > 0] - 1
            front = before[text[before] == c]
            bucket.append(front)
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        first = text[before]
        up = first > c
        before, first = before[up], first[up]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        for b in np.unique(first).tolist():
            lo, hi = np.searchsorted(first, [b, b + 1])
            waiting[b].append(before[lo:hi])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the prefix that each suffix in ``order`` shares with the one before it, counted to ``depth`` at most; 0 for the first."""
    eights = _eights(text)
    lcp = np.zeros(len(order), dtype=np.int32)
    pair = np.arange(1, len(order))
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    for done in range(0, depth, 8):
        x, y = a[pair - 1] + done, b[pair - 1] + done
        inside = (x < len(text)) & (y < len(text))
        pair, x, y = pair[inside], x[inside], y[inside]
        differ = eights[x] ^ eights[y]
        same = differ == 0
        # bytes before the highest bit that differs; zeros behind the end are no bytes of the text
        shared = np.full(len(pair), 8)
        top = differ[~same]
        n = np.zeros(len(top), dtype=np.int64)
        for shift in (32, 16, 8):
            empty = (top >> U(64 - shift)) == 0
            n += np.where(empty, shift // 8, 0)
            top = np.where(empty, top << U(shift), top)
        shared[~same] = n
        lcp[pair] = np.minimum(done + shared, np.minimum(len(text) - a[pair - 1], len(text) - b[pair - 1]))
        pair = pair[same]
        if not len(pair):
            break
    return np.minimum(lcp, depth)
