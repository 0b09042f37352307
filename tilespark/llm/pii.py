"""Personal data: fixed patterns, and a linear-chain conditional random field for what stands too close together for them.

The patterns (email, ip, card, phone) are taken as they are: leftmost matches of each kind, and a match that fails its test (parts up to 255, number of
digits, Luhn) is dropped with all it covers. So a card after a card, or a phone before an address, is lost to them. The conditional random field reads such
stretches token by token: tokens are runs of digits, of letters, of white space, and single other characters; features are word shapes of a
token and its neighbours. Labels are a kind and the place of the group within it (first, second, ... group of digits), so that a chain can tell where one
number ends and the next begins. It is trained by gradient on the log-likelihood of a small labelled table, and decoded by Viterbi in numpy over batches of
stretches. Its finds are added where they pass the kind's own test and touch no span of the patterns, which stay as they are. (An email has no test to fail, so none is added.)

A token can only be labelled within ``REACH`` tokens of a digit, ``@`` or ``+``; everything else is outside by the model's definition, which parts the chain there exactly. Time is in proportion to the
text; documents are independent rows, and no group or document is gathered anywhere.

Defined cases: null text is empty and has no spans; texts are read whole; repeated rows are answered each; null ids stay null; empty tables give an empty
result; other columns are ignored, whatever their names. The labelled table is bounded by ``MAX_ROWS`` rows; null or empty texts in it teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm.shared import bounded_batches, with_fields

KINDS = ("email", "ip", "card", "phone")
#: Groups that are told apart within a kind; later ones share the last label.
GROUPS = {"email": 2, "ip": 4, "card": 5, "phone": 5}
LABELS = [("", 0)] + [(k, g) for k in KINDS for g in range(1, GROUPS[k] + 1)]
NUMBER = {label: k for k, label in enumerate(LABELS)}
OUTSIDE = 0
#: Tokens on either side of a digit, @ or + that may have a label.
REACH = 6
#: Rows of the labelled table that are used, at most.
MAX_ROWS = 5_000
#: Characters of documents that are cut into tokens together (a longer document is taken alone).
TOGETHER = 1_000_000
#: Between documents; enough of them that no feature or stretch reaches across.
EDGE, EDGES = "\U0010ffff", 2 * REACH + 6

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    doubled = [2 * int(x) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def valid(kind: str, text: str) -> bool:
    """A kind's own test of a match."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(d := _digits(text)) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(_digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its @, so that long runs of letters are walked once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in BEFORE_AT:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if valid("ip", m[0])]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and valid("card", m[0])]
    return found + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if valid("phone", m[0])]


# tokens and their shapes

_ASCII = np.zeros(128, np.uint8)  # 0 other, 1 digit, 2 letter, 3 white space
_ASCII[48:58], _ASCII[65:91], _ASCII[97:123] = 1, 2, 2
_ASCII[[9, 10, 11, 12, 13, 32]] = 3
_HEX = np.zeros(128, bool)
_HEX[97:103] = _HEX[65:71] = True
SLOTS = 14


class Tokens:
    """Tokens of a text as arrays: start, end, shape, and whether a token separates the groups of a number."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ascii_ = codes < 128
        low = np.where(ascii_, codes, 0)
        kind = np.where(ascii_, _ASCII[low], 2).astype(np.uint8)
        kind[codes == ord(EDGE)] = 0
        first = np.ones(len(codes), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], len(codes))
        self.kind = kind[self.start]
        length = self.end - self.start
        code = codes[self.start]
        shape = np.where(code == ord(EDGE), 0, np.where((code > 32) & (code < 127), 80 + code.astype(np.int64) - 33, 79))
        shape = np.where(self.kind == 3, np.where((code == 32) & (length == 1), 70, 71), shape)
        if len(codes):
            upper = np.add.reduceat(((codes >= 65) & (codes < 91)).astype(np.int32), self.start)
            hexa = np.add.reduceat((ascii_ & _HEX[low]).astype(np.int32), self.start)
            wide = np.add.reduceat((~ascii_).astype(np.int32), self.start)
            case = np.where(wide > 0, 3, np.where(upper == 0, 0, np.where(upper == length, 2, 1)))
            letters = 30 + case * 4 + np.searchsorted([1, 3, 7], length) + 16 * (hexa == length)
            shape = np.where(self.kind == 2, letters, shape)
        self.shape = np.where(self.kind == 1, np.minimum(length, 20), shape).astype(np.int64)
        for i in np.flatnonzero((self.kind == 1) & (length >= 13) & (length <= 19)):
            if luhn(text[self.start[i] : self.end[i]]):
                self.shape[i] = 180 + length[i]
        for i in np.flatnonzero((self.kind == 1) & (length == 3)):
            if text[self.start[i]] > "2" or text[self.start[i] : self.end[i]] > "255":
                self.shape[i] = 21
        self.separates = (self.kind == 3) | ((self.kind == 0) & (code != ord("+")) & (code != ord("@")))
        marks = np.flatnonzero((self.kind == 1) | (code == ord("@")) | (code == ord("+")))
        near = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(near, np.maximum(marks - REACH, 0), 1)
        np.add.at(near, np.minimum(marks + REACH + 1, len(self.start)), -1)
        inside = np.cumsum(near[:-1]) > 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.stretches = list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))

    def features(self, at: np.ndarray) -> np.ndarray:
        """A number for each of the ``SLOTS`` features of tokens: its slot and up to two shapes."""
        around = np.concatenate([np.zeros(3, np.int64), self.shape, np.zeros(3, np.int64)])
        p3, p2, p1, own, n1, n2, n3 = (around[at + k] for k in range(7))
        zero = np.zeros_like(own)
        pairs = [(own, zero), (p1, zero), (n1, zero), (p2, zero), (n2, zero), (p3, zero), (n3, zero), (own, p1), (own, n1), (p1, n1), (p2, p1), (n1, n2), (own, p2), (own, n2)]
        return np.stack([(slot << 16) | (a << 8) | b for slot, (a, b) in enumerate(pairs)], axis=1)


def padded(lengths: list[int], most: int = 60_000) -> Iterator[list[int]]:
    """Sequences of like length, together up to ``most`` tokens with padding."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    some: list[int] = []
    for k in order:
        if some and (len(some) + 1) * lengths[k] > most:
            yield some
            some = []
        some.append(k)
    if some:
        yield some


class Field:
    """Weights of a linear-chain conditional random field over the features of :class:`Tokens`."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, moves: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.known, self.weights, self.moves, self.begin, self.end = known, weights, moves, begin, end
        self.row = np.zeros(SLOTS << 16, np.int32)  # row 0 of the weights is for features never seen: zeros
        self.row[known] = np.arange(1, len(known) + 1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        found = np.zeros((len(features), len(LABELS)), np.float32)
        for slot in range(features.shape[1]):
            found += self.weights[self.row[features[:, slot]]]
        return found

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of sequences (padded to sequence, step, label); behind a sequence's end the result has no meaning."""
        n, steps, _ = scores.shape
        best = scores[:, 0] + self.begin
        back = np.zeros((n, steps, len(LABELS)), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.moves
            back[:, t] = ways.argmax(axis=1)
            on = (t < lengths)[:, None]
            best = np.where(on, ways.max(axis=1) + scores[:, t], best)
        at = (best + self.end).argmax(axis=1)
        path = np.zeros((n, steps), np.int8)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            path[:, t] = at
            at = np.where(t < lengths, back[rows, t, at], at) if t else at
        return path

    def labels(self, tokens: Tokens) -> np.ndarray:
        """The best label of every token."""
        out = np.zeros(len(tokens.start), np.int8)
        if not tokens.stretches:
            return out
        begins = np.array([a for a, _ in tokens.stretches])
        lengths = np.array([b - a for a, b in tokens.stretches])
        for some in padded(lengths.tolist()):
            size = int(lengths[some].max())
            at = begins[some][:, None] + np.arange(size)
            inside = np.arange(size) < lengths[some][:, None]
            scores = np.zeros((len(some), size, len(LABELS)), np.float32)
            scores[inside] = self.scores(tokens.features(at[inside]))
            out[at[inside]] = self.decode(scores, lengths[some])[inside]
        return out

    def spans(self, tokens: Tokens) -> list[tuple[str, int, int]]:
        """(kind, start, end) in characters: from a first group to the last token of its kind that is a group."""
        labels = self.labels(tokens)
        found: list[tuple[str, int, int]] = []
        open_ = None
        for i in np.flatnonzero(labels).tolist():
            kind, group = LABELS[labels[i]]
            if tokens.separates[i]:
                continue
            joined = open_ is not None and open_[0] == kind and group != 1 and bool((labels[open_[3] : i] != OUTSIDE).all())
            if joined:
                open_[2], open_[3] = int(tokens.end[i]), i
            else:
                if open_:
                    found.append(tuple(open_[:3]))
                open_ = [kind, int(tokens.start[i]), int(tokens.end[i]), i]
        if open_:
            found.append(tuple(open_[:3]))
        return found


def taught(tokens: Tokens, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Labels of tokens under given spans."""
    out = np.zeros(len(tokens.start), np.int64)
    for kind, start, end in spans:
        group = 0
        for i in np.flatnonzero((tokens.start >= start) & (tokens.end <= end)):
            group += not tokens.separates[i]
            out[i] = NUMBER[kind, min(max(group, 1), GROUPS[kind])]
    return out


def by_feature(features: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slot its features, and the places of each, one feature after the other."""
    found = []
    for which in features.reshape(-1, features.shape[2]).T:
        order = np.argsort(which, kind="stable")
        held, starts = np.unique(which[order], return_index=True)
        found.append((held, order, starts))
    return found


def likelihood(weights, moves, begin, end, features, labels, lengths, places=None):
    """Mean log-likelihood of labelled sequences, and its gradients; by forward and backward sums over all sequences at once.

    ``features`` are rows of weights (sequence, step, slot), 0 behind a sequence's end.
    """
    n, steps, _ = features.shape
    rows = np.arange(n)
    inside = np.arange(steps) < lengths[:, None]
    scores = sum(weights[features[:, :, slot]] for slot in range(features.shape[2]))

    # chances are scaled to sum to 1 at every step, so that steps are plain products
    high = scores.max(axis=2)
    height, move = np.exp(scores - high[..., None]), np.exp(moves)
    ahead, back, scale = np.zeros(scores.shape), np.zeros(scores.shape), np.ones((n, steps))
    first = height[:, 0] * np.exp(begin)
    scale[:, 0] = first.sum(axis=1)
    ahead[:, 0] = first / scale[:, :1]
    for t in range(1, steps):
        on = inside[:, t, None]
        new = np.where(on, (ahead[:, t - 1] @ move) * height[:, t], ahead[:, t - 1])
        scale[:, t] = np.where(on[:, 0], new.sum(axis=1), 1)
        ahead[:, t] = new / scale[:, t, None]
    ends = (ahead[:, -1] * np.exp(end)).sum(axis=1)
    total = np.log(scale).sum(axis=1) + (high * inside).sum(axis=1) + np.log(ends)
    back[:, -1] = np.exp(end) / ends[:, None]
    g_moves = np.zeros(moves.shape)
    for t in range(steps - 1, 0, -1):
        on = inside[:, t, None]
        behind = np.where(on, height[:, t] * back[:, t] / scale[:, t, None], 0)
        g_moves -= move * (ahead[:, t - 1].T @ behind)
        np.add.at(g_moves, (labels[inside[:, t], t - 1], labels[inside[:, t], t]), 1)
        back[:, t - 1] = np.where(on, behind @ move.T, back[:, t])
    chance = ahead * back * inside[..., None]
    given = np.zeros(scores.shape)
    np.put_along_axis(given, labels[..., None], 1, 2)
    given *= inside[..., None]
    off = given - chance
    last = lengths - 1
    value = (given * scores).sum() + begin[labels[:, 0]].sum() + end[labels[rows, last]].sum() - total.sum()
    value += sum(moves[labels[inside[:, t], t - 1], labels[inside[:, t], t]].sum() for t in range(1, steps))
    g_weights = np.zeros(weights.shape)
    flat = off.reshape(n * steps, -1)
    for held, order, starts in by_feature(features) if places is None else places:
        g_weights[held] += np.add.reduceat(flat[order], starts, axis=0)
    g_weights[0] = 0
    return value / n, [g / n for g in (g_weights, g_moves, off[:, 0].sum(axis=0), off[rows, last].sum(axis=0))]


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.15, shrink: float = 2e-4) -> Field:
    """Weights that make the labelled rows likely: gradient steps scaled by running squares, with weights drawn towards 0."""
    features, labels = [], []
    for text, spans in rows:
        tokens = Tokens(EDGE * EDGES + (text or "") + EDGE * EDGES)
        given = taught(tokens, [(k, a + EDGES, b + EDGES) for k, a, b in spans])
        for a, b in tokens.stretches:
            features.append(tokens.features(np.arange(a, b)))
            labels.append(given[a:b])
    if not features:
        zero = np.zeros(len(LABELS))
        return Field(np.zeros(0, np.int64), np.zeros((1, len(LABELS)), np.float32), np.zeros((len(LABELS),) * 2), zero, zero)
    known = np.unique(np.concatenate(features))
    lengths = np.array([len(x) for x in labels])
    which = np.zeros((len(labels), int(lengths.max()), SLOTS), np.int64)
    given = np.zeros(which.shape[:2], np.int64)
    for k, (f, y) in enumerate(zip(features, labels, strict=True)):
        which[k, : len(y)] = np.searchsorted(known, f) + 1
        given[k, : len(y)] = y
    size = len(LABELS)
    values = [np.zeros((len(known) + 1, size)), np.zeros((size, size)), np.zeros(size), np.zeros(size)]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    groups = [(f := which[g, : lengths[g].max()], given[g, : lengths[g].max()], lengths[g], by_feature(f)) for g in padded(lengths.tolist(), 4_000)]
    for k in range(1, rounds + 1):
        slopes = [np.zeros_like(v) for v in values]
        for group in groups:
            for sum_, g in zip(slopes, likelihood(*values, *group)[1], strict=True):
                sum_ += g * len(group[2]) / len(lengths)
        for v, m, s, g in zip(values, mean, square, slopes, strict=True):
            g = g - shrink * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        values[0][0] = 0
    return Field(known, values[0].astype(np.float32), *values[1:])


# the labelled table


def labelled(rows: int = 300, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table, made by rule: values of each kind in the usual spellings and numbers that are none, among words, apart and close together."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda: "".join(pick("abcdefghilmnoprstuvé") for _ in range(int(rng.integers(1, 10))))

    def card() -> str:
        sizes = pick([(4, 4, 4, 4)] * 6 + [(4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 4, 1)])
        body = digits(sum(sizes) - 1)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        groups = [number[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes))]
        return pick(["", "", " ", "-"]).join(groups)

    def phone() -> str:
        n = lambda k: digits(k)
        return pick([f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}"] * 3 + [f"+{n(1)}-{n(3)}-{n(3)}-{n(4)}", f"+{n(2)} {n(2)} {n(4)} {n(4)}", f"+{n(2)} {n(3)} {n(7)}", f"+{n(2)}.{n(2)}.{n(4)}.{n(4)}", f"+{n(11)}", f"+{n(2)} {n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+{n(2)} ({n(2)}) {n(4)}-{n(4)}"])

    def other() -> str:
        h = "".join(pick("0123456789abcdef") for _ in range(40))
        body = digits(15)
        bad = body + next(c for c in "0123456789" if not luhn(body + c))
        return pick([f'token = "{h}"', h[:12], bad, digits(int(rng.integers(1, 9))), f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}:3{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"${digits(1)},{digits(3)}.00", f"{digits(2)}%", f"@{word()}", f"+{digits(1)}", f"{word()}+{word()}", digits(24), f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}.{digits(3)}"])

    make = {
        "email": lambda: f"{word()}{pick(['.', '_', ''])}{digits(int(rng.integers(0, 3)))}@{pick(['mail', 'post', 'x-y'])}{pick(['', digits(1)])}.{pick(['example.com', 'org', 'net'])}",
        "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": card,
        "phone": phone,
        "other": other,
        "word": lambda: word().capitalize() if rng.random() < 0.2 else word(),
    }
    found = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(int(rng.integers(3, 10))):
            kind = pick(["word", "word", "other", "card", "phone", "ip", "email", "card", "phone", "ip"])
            value = make[kind]()
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + pick([" "] * 6 + [", ", "\n", " | ", "$$$ ", "; ", ". "])
        found.append((text, spans))
    return found


def fit(table: DataFrame) -> Field:
    """Trained on a table of ``text, spans array<struct<kind, start, end>>``; at most ``MAX_ROWS`` rows, the first by a hash of their text."""
    rows = table.filter("text IS NOT NULL").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(MAX_ROWS).collect()
    return train([(r.text, [(s[0], s[1], s[2]) for s in r.spans or []]) for r in rows])


def all_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """For each text, (kind, start, end, whether a pattern found it), by kind, then start."""
    found = []
    for text in texts:
        found.append([(*s, True) for s in base_spans(text)])
    tried = [k for k, t in enumerate(texts) if re.search("[0-9@+]", t)]
    at = 0
    while at < len(tried):
        some, size = [], 0
        while at < len(tried) and (not some or size + len(texts[tried[at]]) <= TOGETHER):
            some.append(tried[at])
            size, at = size + len(texts[tried[at]]), at + 1
        edges = EDGE * EDGES
        begins = np.cumsum([EDGES] + [len(texts[k]) + EDGES for k in some[:-1]])
        joined = edges + edges.join(texts[k] for k in some) + edges
        for kind, start, end in field.spans(Tokens(joined)):
            which = int(np.searchsorted(begins, start, "right")) - 1
            k, a, b = some[which], start - int(begins[which]), end - int(begins[which])
            text = texts[k]
            own = text[a:b]
            apart = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
            if kind != "email" and apart and {"ip": IP, "card": CARD, "phone": PHONE}[kind].fullmatch(own) and valid(kind, own) and all(b <= s or a >= e for _, s, e, _ in found[k]):
                found[k].append((kind, a, b, False))
    order = {kind: n for n, kind in enumerate(KINDS)}
    return [sorted(x, key=lambda s: (order[s[0]], s[1])) for x in found]


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(documents: DataFrame, field: Field, carry: list[str] | None = None) -> DataFrame:
    """The carried columns and ``spans``: kind, start, end (code points, end exclusive), and whether a pattern found it."""
    carry = ["doc_id"] if carry is None else carry
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(field)  # a weight for each shape of the labelled table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans([t or "" for t in batch.column(len(carry)).to_pylist()], sent.value)
            rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(rows, SPANS_ARROW)], names=[*names, "spans"])

    names = [f"c{k}" for k in range(len(carry))]  # names of the caller's may hold any character
    own = [F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in zip(carry, names, strict=True)]
    lean = documents.select(*own, F.col("text").cast("string").alias("text"))
    found = lean.mapInArrow(run, with_fields(lean, names, f"spans {SPANS}"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "spans")


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(labelled(), "text string, spans array<struct<kind: string, start: long, end: long>>")
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit(table))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op11_pii": op11_pii}
ORACLE: dict[str, str] = {}
