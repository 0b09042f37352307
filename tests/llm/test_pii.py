"""Personal data: patterns against the plain expressions, the random field against enumeration, and held-out texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tilespark.llm import pii

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            check = sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and check % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((kind, m.start(), m.end()))
    return found


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled())


def test_patterns_are_the_plain_expressions():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("aZ9012345 .-+@()é%_\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_base(text), text
    for text, _ in pii.labelled(200, 5):
        assert pii.base_spans(text) == plain_base(text)
    for text in ("a@b.c@d.e", "@x.y", "é.b@x.y.", "0001.02.3.255 256.1.1.1.1.1.1", "4111 1111 1111 1111 1", "+1+49 30 1234567", "a@b..c @@ a@b.c"):
        assert pii.base_spans(text) == plain_base(text)


def test_long_runs_take_time_in_proportion():
    for text in ("x" * 2_000_000, "1" * 300_000, "a@" * 200_000, "+1-" * 200_000, "1." * 200_000, "@a" * 200_000):
        assert pii.base_spans(text) == [] or "1." in text


def test_best_path_and_likelihood_by_enumeration():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    known = np.arange(5)
    weights = [rng.normal(size=(6, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k)]
    weights[0][0] = 0
    which = rng.integers(1, 6, (3, 3, 2))
    lengths = np.array([3, 2, 1])
    labels = rng.integers(0, k, (3, 3))
    for s in range(3):
        which[s, lengths[s] :] = 0

    def score(s, path):
        x = weights[2][path[0]] + weights[3][path[-1]]
        x += sum(weights[0][which[s, t]].sum(axis=0)[y] for t, y in enumerate(path))
        return x + sum(weights[1][a, b] for a, b in itertools.pairwise(path))

    field = pii.Field(known, weights[0].astype(np.float32), *weights[1:])
    paths = field.decode(weights[0][which].sum(axis=2), lengths)
    value = 0.0
    for s in range(3):
        every = {p: score(s, p) for p in itertools.product(range(k), repeat=int(lengths[s]))}
        assert tuple(paths[s, : lengths[s]]) == max(every, key=every.get)
        x = np.array(list(every.values()))
        value += every[tuple(labels[s, : lengths[s]])] - (np.log(np.exp(x - x.max()).sum()) + x.max())
    got, slopes = pii.likelihood(*weights, which, labels, lengths)
    assert got == pytest.approx(value / 3)
    for w, g in zip(weights, slopes, strict=True):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)]:
            if w.ndim == 2 and w.shape[0] == 6 and at[0] == 0:
                continue
            w[at] += 1e-5
            up = pii.likelihood(*weights, which, labels, lengths)[0]
            w[at] -= 2e-5
            down = pii.likelihood(*weights, which, labels, lengths)[0]
            w[at] += 1e-5
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_texts(field):
    """What stands close together is found although the patterns lose it; nothing else is added."""
    right = wrong = missed = lost = 0
    for text, spans in pii.labelled(300, seed=99):
        base = {s for s in plain_base(text)}
        added = {s[:3] for s in pii.all_spans([text], field)[0] if not s[3]}
        free = {s for s in spans if s not in base and all(s[2] <= a or s[1] >= b for _, a, b in base)}
        lost += len(free)
        right, wrong, missed = right + len(added & set(spans)), wrong + len(added - set(spans)), missed + len(free - added)
    assert lost > 150 and right > 0.95 * lost and wrong <= 2


def test_pairs_that_patterns_lose(field):
    card, other = "4845168114407329", "7536784127813050"
    values = {"card": card, "ip": "170.106.47.218", "phone": "+1 (843) 555-7672", "email": "la.72@mail3.example.com"}
    for (a, x), (b, y) in itertools.product(values.items(), {**values, "card": other}.items()):
        for gap in (" ", ", ", " | "):
            text = f"de la {x}{gap}{y} the rely."
            start = len("de la ")
            want = {(a, start, start + len(x)), (b, start + len(x) + len(gap), start + len(x) + len(gap) + len(y))}
            assert want <= {s[:3] for s in pii.all_spans([text], field)[0]} or any(s[2] - s[1] > max(len(x), len(y)) for s in plain_base(text)), text


def test_texts_are_independent_of_each_other(field):
    texts = [t for t, _ in pii.labelled(60, seed=3)] + ["", "no digits at all", "é" * 50 + " 1"]
    together = pii.all_spans(texts, field)
    assert together == [pii.all_spans([t], field)[0] for t in texts]
    old = pii.TOGETHER
    try:
        pii.TOGETHER = 100
        assert pii.all_spans(texts, field) == together
    finally:
        pii.TOGETHER = old


def test_odd_documents(spark, odd_docs, no_docs, field):
    got = pii.find(odd_docs, field, carry=["doc_id", "weird na`me", "score"])
    assert got.columns == ["doc_id", "weird na`me", "score", "spans"] and got.count() == odd_docs.count()
    rows = odd_docs.collect()
    assert sum(len([s for s in r.spans if s.base]) for r in got.collect()) == sum(len(plain_base(r.text or "")) for r in rows)
    assert pii.find(no_docs, field).collect() == []


def test_a_table_without_lessons_adds_nothing(spark):
    empty = pii.fit(spark.createDataFrame([(None, None), ("", [])], "text string, spans array<struct<kind: string, start: long, end: long>>"))
    text = "7536784127813050 4845168114407329 10.0.0.1"
    assert [s[:3] for s in pii.all_spans([text], empty)[0]] == plain_base(text)


def test_the_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pii.op11_pii(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(said) <= set(spans)
        key = [(list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert key == sorted(key)
