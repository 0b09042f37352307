"""Sets of hashed word shingles, computed for whole batches of texts with NumPy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A 64-bit number for every byte; words are polynomials in an odd base over them, mixed afterwards.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: U, n: int) -> np.ndarray:
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order and the number of the text each belongs to."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[::2], edge[1::2]
    weighed = np.concatenate([[U(0)], np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), dtype=np.uint64)])
    h = (weighed[ends] - weighed[starts]) * _power(_BASE_INVERSE, len(raw))[starts]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(begins, starts, side="right") - 1


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``k`` words; fewer words are one shingle, none an empty set.

    A-Z are lower-cased; words are runs of anything but space and 0x09-0x0D.
    """
    h, text = word_hashes([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts])
    n = np.bincount(text, minlength=len(texts))
    s, at = h.copy(), text
    for r in range(1, k):
        s = mix(s[: len(h) - r] * U(0xD6E8FEB86659FD93) + h[r:])
        at = at[: len(h) - r]
    whole = at == text[k - 1 :] if len(h) >= k else np.zeros(0, dtype=bool)
    s, at = s[: len(whole)][whole], at[: len(whole)][whole]
    cuts = np.searchsorted(at, np.arange(len(texts) + 1))
    first = np.concatenate([[0], np.cumsum(n)])
    sets = []
    for i in range(len(texts)):
        if n[i] >= k:
            sets.append(np.unique(s[cuts[i] : cuts[i + 1]]))
        elif n[i]:
            one = h[first[i] : first[i] + 1]
            for x in h[first[i] + 1 : first[i] + n[i]]:
                one = mix(one * U(0xA0761D6478BD642F) + x)
            sets.append(mix(one + U(n[i])))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def sketches(sets: list[np.ndarray], t: int = 128) -> np.ndarray:
    """Fast similarity sketches: a row of ``t`` coordinates for every set; rows of empty sets are zero.

    In round r every element is thrown into one of the t bins with a random value; a bin takes the least value of the first round that
    reaches it. After t rounds, round t + b throws every element into bin b, so each coordinate is filled. Two sets agree in a
    coordinate with the probability of their similarity, and the coordinates' mean is concentrated as for independent ones.
    """
    bins = U(t)
    sizes = np.array([len(x) for x in sets])
    out = np.zeros((len(sets), t), dtype=np.uint64)
    open_rows = np.flatnonzero(sizes)
    empty = U(2**64 - 1)
    filled = np.full((len(sets), t), empty, dtype=np.uint64)
    for r in range(2 * t):
        if not len(open_rows):
            break
        flat = np.concatenate([sets[i] for i in open_rows])
        row = np.repeat(np.arange(len(open_rows)), sizes[open_rows])
        v = mix(flat ^ mix(np.array([r + 1], dtype=np.uint64) * _BASE))
        b = v % bins if r < t else np.full(len(v), r - t, dtype=np.uint64)
        now = np.full(len(open_rows) * t, empty, dtype=np.uint64)
        np.minimum.at(now, row * t + b.astype(np.int64), v >> U(8))
        now = now.reshape(len(open_rows), t)
        old = filled[open_rows]
        take = (old == empty) & (now != empty)
        # the round is part of the value: bins filled in different rounds never agree
        old[take] = mix(now + mix(np.array([r], dtype=np.uint64)))[take] >> U(1)
        filled[open_rows] = old
        open_rows = open_rows[(old == empty).any(1)]
    some = sizes > 0
    out[some] = filled[some]
    return out


def bands_for(threshold: float, t: int = 128, miss: float = 1e-6) -> tuple[int, int]:
    """Bands and rows a band: the most rows for which a pair at the threshold is missed with a chance of ``miss`` at most."""
    fit = [r for r in range(1, t + 1) if (1 - threshold**r) ** (t // r) <= miss]
    rows = max(fit, default=1)
    return t // rows, rows


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch, the band's number mixed in."""
    keys = np.zeros((len(sketch), bands), dtype=np.uint64)
    for b in range(bands):
        k = np.full(len(sketch), b + 1, dtype=np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            k = mix(k * U(0xD6E8FEB86659FD93) + sketch[:, c])
        keys[:, b] = k
    return keys
