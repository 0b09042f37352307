"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tilespark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = Counter()
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        for k, (s, _, i) in enumerate(sorted(found)[:top]):
            rows[item, k + 1, i, -s] += 1
    return rows


def answers(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*r, "own", 3) for r in docs], "doc_id long, text string, term string, score int").repartition(3),
        spark.createDataFrame([(*r, "own", 3) for r in items], "item_id long, text string, doc_id string, rank int"),
    )


def odd_tables(n=600):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["Ünder", "É", "日本", "42", "The", "a_b", "x-y", "😀"]
    weight = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weight, k=rng.randrange(1, 120)))) for k in range(n)]
    docs += [docs[5], docs[5], (7, docs[9][1]), (None, docs[5][1]), (None, None), (9001, ""), (9002, "--- \x00 __"), (9003, "w7 " * 400_000 + "w250 w251"), *[(10_000 + k, "tie of w3 and w4") for k in range(50)]]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 150)))) for k in range(25)] + [(100, None), (101, ""), (102, "never seen"), (103, "w3 w3 W3 tie of"), (103, "w3 w3 W3 tie of"), (103, "w9"), (None, "w250 w251 ünder")]
    return docs, items


@pytest.mark.parametrize("item_chars", [ranked.ITEM_CHARS, 500])
def test_against_every_document(spark, monkeypatch, item_chars):
    docs, items = odd_tables()
    d, i = tables(spark, docs, items)
    assert answers(ranked.search(d, i, item_chars=item_chars)) == brute(docs, items)
    assert answers(ranked.search(d, i, top=3, item_chars=item_chars)) == brute(docs, items, 3)


def test_small_rows_of_postings():
    """The best go from row to row, whatever the rows hold."""
    docs, items = odd_tables(200)
    known = {}
    asked = [[(known.setdefault(t, len(known)), q) for t, q in Counter(x.encode() for x in terms(text)).items()] for _, text in items]

    class Sent:
        def __init__(self, value):
            self.value = value

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    whole = list(ranked._postings(Sent(known))(iter([batch])))
    n, total = sum(b["seen"][0].as_py() for b in whole), sum(b["total"][0].as_py() for b in whole)
    old = ranked.DOCS
    try:
        ranked.DOCS = 7
        parts = list(ranked._postings(Sent(known))(iter([batch])))
    finally:
        ranked.DOCS = old
    assert len(parts) > 20 and sum(b["total"][0].as_py() for b in parts) == total
    df = Counter(t for _, text in docs for t in set(terms(text)))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t.decode()] + 1))) for t in known], np.int64)
    a, b = (next(ranked._ranked(Sent((asked, weights, n, total)), 20)(iter(x))) for x in (whole, parts))
    assert a.equals(b)


def test_masks_are_grouped_whatever_their_width():
    rng = np.random.default_rng(1)
    for words in (1, 3):
        masks = rng.integers(0, 3, (500, words)).astype(np.uint64)
        order, starts = ranked.grouped(masks)
        groups = [masks[order[a:b]] for a, b in zip(starts, [*starts[1:], 500], strict=True)]
        assert all((g == g[0]).all() for g in groups) and len({tuple(g[0]) for g in groups}) == len(groups)


def test_empty_tables(spark):
    docs, items = odd_tables(20)
    for d, i in (([], items), (docs, []), ([], []), ([(1, None), (2, "")], items)):
        assert answers(ranked.search(*tables(spark, d, i))) == Counter()


def test_the_query(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert answers(ranked.op12_ranked(spark, SF)) == brute(docs, items)
