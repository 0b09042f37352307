"""Every operator on documents against brute force, on odd rows and on none."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tilespark.llm import bpe, language, mixing, neardup, quality, repeats, shingles, simhash, suffix_array
from tilespark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    return odd_docs.select("doc_id", "text", "source", "lang").unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100).select("doc_id", "text", "source", "lang")).cache()


# near-duplicates


def shingle_set(text, k):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 250_000), (5, 80, 300)])
def test_near_duplicates(docs, monkeypatch, k, percent, block):
    monkeypatch.setattr(neardup, "BLOCK_HASHES", block)
    rows = docs.collect()
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    sets = [(r.doc_id, shingle_set(r.text, k)) for r in rows if r.doc_id is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    want = Counter((r.doc_id, len(shingle_set(r.text, k)), None if r.doc_id is None else root(r.doc_id), r.doc_id is None or root(r.doc_id) == r.doc_id) for r in rows)
    assert Counter(map(tuple, neardup.near_duplicates(docs, k, percent).collect())) == want


def test_near_duplicates_in_a_family(spark, monkeypatch):
    # one frame shared by all and half of each text its own: one candidate component, few links, and no pair but those that are nearly linked is looked at
    monkeypatch.setattr(neardup, "BLOCK_HASHES", 2_000)
    frame_ = [f"frame{i}" for i in range(60)]
    looked = []
    texts = {}
    for i in range(150):
        own = [f"own{i}x{j}" for j in range(50)]
        texts[i] = " ".join(frame_ + own)
        if i % 10 == 0:
            texts[1000 + i] = " ".join([*frame_, *own[:-1], "changed"])
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    confirm = neardup.links_between
    monkeypatch.setattr(neardup, "links_between", lambda sets, percent: looked.append(sets.count()) or confirm(sets, percent))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(rows, 3, 85).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i in texts}
    assert looked and looked[0] > 50


def test_links_between_are_all_found(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < keep], rng.integers(0, 2**62, 6).astype(np.uint64)])) for keep in rng.choice([0.7, 0.95, 0.99], 120)]
    label = rng.integers(0, 12, 120)
    rows = [(5, int(y), 0, i, x.tobytes()) for i, (x, y) in enumerate(zip(sets, label, strict=True))]
    df = spark.createDataFrame(rows, "component long, label long, giant long, doc_id long, set binary")
    root = {("label", int(y)): ("label", int(y)) for y in label}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if label[i] != label[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                root[find(("label", int(label[i])))] = find(("label", int(label[j])))
    want = {frozenset(y for y in range(12) if ("label", y) in root and find(("label", y)) == r) for r in {find(x) for x in root}}
    # the edges found join the labels that links join, and no others
    mine = {int(y): int(y) for y in label}
    for r in neardup.links_between(df, 80).collect():
        x, y = sets[r.a], sets[r.b]
        both = len(np.intersect1d(x, y))
        assert 100 * both >= 80 * (len(x) + len(y) - both)
        a, b = mine[int(label[r.a])], mine[int(label[r.b])]
        mine = {k: a if v == b else v for k, v in mine.items()}
    assert {frozenset(k for k in mine if mine[k] == v) for v in mine.values()} == want and linked > 100


@pytest.mark.parametrize("block", [250, 100_000])
def test_possible_leaves_out_only_what_has_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_HASHES", block)
    rng = np.random.default_rng(9)
    frame_ = rng.integers(0, 2**62, 50).astype(np.uint64)
    own = lambda n: rng.integers(0, 2**62, n).astype(np.uint64)
    sets = [np.unique(np.concatenate([frame_, own(50)])) for _ in range(60)]
    sets += [np.unique(np.concatenate([x[:-3], own(3)])) for x in sets[:5]]
    df = spark.createDataFrame([(5, i, 0, i, x.tobytes()) for i, x in enumerate(sets)], "component long, label long, giant long, doc_id long, set binary")
    assert {r.doc_id for r in neardup.possible(df, 85).collect()} == {*range(5), *range(60, 65)}
    assert {tuple(sorted((r.a, r.b))) for r in neardup.links_between(df, 85).collect()} == {(i, 60 + i) for i in range(5)}


def test_near_duplicates_of_nothing(no_docs):
    assert neardup.near_duplicates(no_docs).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for n, shared in ((4, 2), (40, 30), (600, 540)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)])
        s = shingles.sketches([np.unique(a), np.unique(b)], 1024)
        assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.08
    assert shingles.bands_for(0.85) == (25, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(5, 300), (400, 401), (400, 400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(61), 300]) and all(got[i] == 200 for i in range(200, 260)) and got[401] == 400
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_are_few_files(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(x) for x in names]
    try:
        for name, value in zip(names, ("32", "false"), strict=True):
            spark.conf.set(name, value)
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 1000, 2)], "a long, b long")
        found = connected_components(edges)
        assert len(found.inputFiles()) == 1  # and not one for each of 32 partitions
        assert {(r.node, r.component) for r in found.collect()} == {(i, i - i % 2) for i in range(1000)}
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


# repeated passages


@pytest.mark.parametrize("hot", [4_000, 0])
def test_repeats(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    rows = docs.collect()
    seen = Counter(b[i : i + 200] for r in rows for b in [(r.text or "").encode()] for i in range(len(b) - 199))
    want = Counter()
    for r in rows:
        b = (r.text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[(r.doc_id, len(b), int(gone.sum()), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))] += 1
    assert Counter(map(tuple, repeats.without_repeats(docs, digests=True).collect())) == want


def test_repeats_without_ids(spark):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(13)) * 1
    long = " ".join(f"{passage}{i}" for i in range(40))
    rows = [(None if i % 2 else 4, f"begin {i * i} {long if i % 3 == 0 else ' '.join(f'own{i}x{j}' for j in range(120))} end {i * i * 7}") for i in range(300)]
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"])
    got = Counter((r.n_removed > 0, r.n_spans) for r in out.collect())
    assert got == Counter({(True, 1): 100, (False, 0): 200})
    groups = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("id", "key").count().collect()
    assert len(groups) == 100


@pytest.mark.parametrize("hot", [4_000, 0])
def test_repeats_of_short_periods_are_rows_by_run(spark, monkeypatch, hot):
    """Periodic text has a cell for each period, at period 1 for each byte; the places of a kind travel as runs."""
    monkeypatch.setattr(repeats, "HOT", hot)
    own = lambda i: " ".join(f"own{i}x{j * j}" for j in range(40))
    periods = ["y", "Is onhe. ", "".join(map(chr, range(40, 120))) * 2 + "z", "".join(map(chr, range(40, 121))) * 2, own("p")[:300]]
    texts = [own(i) + periods[i % 5] * (3_000 // len(periods[i % 5])) + own(-i - 1) for i in range(25)]
    texts += ["k" * n for n in (199, 200)] + ["m" * 201, "no. " * 50, "go. " * 51 + own("a") + "go. " * 60]  # in one document, or only there
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for k, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want.append((k, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha("".join(x for x, g in zip(t, gone) if not g).encode())))
    assert sorted(map(tuple, repeats.without_repeats(docs, digests=True).collect())) == want
    short = docs.filter("doc_id % 5 < 2 AND doc_id < 25")
    assert repeats.repeated_spans(short).count() <= 5 * short.count()


def test_runs_of_cells_keep_every_window():
    period = b"Is onhe. "
    for text in (period * 1_900_000, (period * 400_000 + bytes(range(65, 91)) * 20) * 5):  # stretches of texts of 16 MB and more
        rows = np.concatenate([np.stack([b.column(c).to_numpy() for c in ("at", "times")], axis=1) for b in repeats._long_cells([(0, 3, 4, text)], 200)])
        first, many, times = rows[:, 0] >> 20, rows[:, 0] & ((1 << 20) - 1), rows[:, 1]
        assert first[0] == 0 and (first[1:] == (first + many * times)[:-1]).all() and (first + many * times)[-1] == len(text) - 199
        assert len(rows) < 1_000


def test_repeats_of_nothing(no_docs):
    assert repeats.without_repeats(no_docs).collect() == []


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for size, letters in ((1, 2), (7, 1), (90, 2), (120, 4), (200, 26)):
        for _ in range(20):
            t = rng.integers(97, 97 + letters, size).astype(np.uint8)
            t = np.concatenate([t, t[: size // 2]])
            raw = t.tobytes()
            for depth in (8, 40, 400):
                order = suffix_array.suffix_array(t, depth).tolist()
                assert sorted(order) == list(range(len(t)))
                assert all(raw[a:][:depth] <= raw[b:][:depth] for a, b in zip(order, order[1:]))
            lcp = suffix_array.common_prefixes(t, np.array(order), 400)
            for k in range(1, len(order)):
                a, b = raw[order[k - 1] :], raw[order[k] :]
                n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert lcp[k] == n


# fingerprints


def fingerprint(text):
    w = re.split("[ \t-\r]+", (text or "").strip(" \t\n\x0b\f\r"))
    terms = [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)] or [w]
    out = ""
    for salt in ([], ["b"]):
        votes = np.zeros(64, dtype=int)
        for term in terms:
            h = 42
            for x in salt + term:
                h = xxhash.xxh64_intdigest(x.encode(), seed=h)
            votes += np.array([h >> b & 1 for b in range(64)])
        out += f"{sum(1 << b for b in range(64) if 2 * votes[b] > len(terms)):016x}"
    return out


def test_simhash(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 20)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    nobody = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), seed=42) + (1 << 63)) % (1 << 64)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, nobody(r.text) if r.doc_id is None else r.doc_id, r.text or ""), reverse=True)
    likeness = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    prints = [fingerprint(r.text) for r in rows]
    count = Counter(prints)
    want = Counter()
    for i, r in enumerate(rows):
        t, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        n, k = len(t), len(t) // 3
        edited = t[: n - k] + after[:k]
        e = fingerprint(edited)
        within = None
        if r.doc_id is not None and r.doc_id % 100 == 0:
            within = sum(c for f, c in count.items() if likeness(f, prints[i]) >= 1 - 3 / 128)
        want[(r.doc_id, n, sha(edited.encode()), prints[i], e, likeness(prints[i], e), likeness(prints[i], prints[(i + 1) % len(rows)]), within)] += 1
    assert Counter(map(tuple, simhash.op3_simhash(spark, str(tmp_path)).collect())) == want


def test_simhash_of_nothing_and_of_one(spark, no_docs, tmp_path):
    no_docs.select("doc_id", "text").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert simhash.op3_simhash(spark, f"{tmp_path}/none").collect() == []
    spark.createDataFrame([(3, "one two three")], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [r.near_next for r in simhash.op3_simhash(spark, f"{tmp_path}/one").collect()] == [1.0]


def test_simhash_without_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 20)
    spark.range(300).selectExpr("CAST(NULL AS BIGINT) doc_id", "concat('text ', id, ' of nobody ', id % 7) text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = simhash.op3_simhash(spark, str(tmp_path)).collect()
    assert len(rows) == 300 and all(r.near_next is not None and r.doc_id is None for r in rows)
    assert max(r["count"] for r in simhash.with_next(spark.read.parquet(f"{tmp_path}/documents.parquet")).groupBy("_bucket").count().collect()) <= 60


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_search_within_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(40)]
    all_ = base + [b ^ sum(1 << int(x) for x in rng.choice(128, k, replace=False)) for b in base for k in (1, radius, radius + 1)]
    all_ = list(dict.fromkeys(all_))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1), 1) for x in all_]
    entries = spark.createDataFrame(rows, "fa long, fb long, n long")
    asked = spark.createDataFrame([r[:2] for r in rows[:40]], "qa long, qb long")
    want = {(rows[i][:2], rows[j][:2]) for i in range(40) for j in range(len(all_)) if bin(all_[i] ^ all_[j]).count("1") <= radius}
    got = [((r.qa, r.qb), (r.fa, r.fb)) for r in simhash.search(asked, entries, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_neighbours_are_named(spark, docs):
    rng = np.random.default_rng(8)
    words = [f"term{i}" for i in range(5_000)]
    rows = []
    for i in range(1, 41):
        text = [words[j] for j in rng.integers(0, 5_000, (100, 200, 500, 1000)[i % 4])]
        rows.append((100 * i, " ".join(text)))
        text[int(rng.integers(1, len(text) - 1))] = "changed"
        rows.append((100 * i + 1, " ".join(text)))
    rows += [(r.doc_id + 10_000_000, r.text) for r in docs.collect() if r.doc_id is not None] + [(None, rows[0][1]), (7, rows[0][1])]
    got = Counter(map(tuple, simhash.neighbours(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 100 == 0).collect()))
    prints = {(i, fingerprint(t)) for i, t in rows}
    ids = defaultdict(set)
    for i, p in prints:
        ids[p].add(i)
    name = {p: min((i for i in of if i is not None), default=None) for p, of in ids.items()}
    apart = lambda p, q: (int(p, 16) ^ int(q, 16)).bit_count()
    asked = [p for p, of in ids.items() if any(i is not None and i % 100 == 0 for i in of)]
    want = {(i, name[p], 0, p) for i, p in prints} | {(name[p], name[q], apart(p, q), q) for p in asked for q in ids if 0 < apart(p, q) <= simhash.RADIUS}
    assert got == Counter(want)
    of_class = {(r[0], r[1]) for r in got}
    assert sum((min(100 * i, name[fingerprint(rows[2 * i - 2][1])]), 100 * i + 1) in of_class for i in range(1, 41)) >= 38


@pytest.mark.parametrize("near", [0, 1, 2, 14, 15, 16])
def test_wide_search_is_whole(spark, near):
    rng = np.random.default_rng(near)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(150)]
    other = list(dict.fromkeys(b ^ sum(1 << int(x) for x in rng.choice(128, near, replace=False)) for b in base))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda x: (signed(x >> 64), signed(x & (1 << 64) - 1))
    q = spark.createDataFrame([(i, *halves(b)) for i, b in enumerate(base)], "q long, qa long, qb long")
    e = spark.createDataFrame([(i, *halves(b)) for i, b in enumerate(other)], "e long, fa long, fb long")
    got = [(r.q, r.e, r.distance) for r in simhash.search_wide(q, e).collect()]
    assert sorted(got) == sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(base) for j, b in enumerate(other) if (a ^ b).bit_count() <= simhash.RADIUS)
    assert len(got) == (150 if near <= simhash.RADIUS else 0)


# token ids


@pytest.mark.parametrize("words", [bpe.BLOCK_WORDS, 40])
def test_bpe(docs, words, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "BLOCK_WORDS", words)
    definition = bpe.default_definition()
    t = Tokenizer.from_str(definition)
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode()))] += 1
    assert Counter(map(tuple, bpe.encode_decode(docs, definition, digests=True).collect())) == want


def test_bpe_of_nothing_and_decode(spark, no_docs):
    definition = bpe.default_definition()
    assert bpe.encode_decode(no_docs, definition).collect() == []
    one = spark.createDataFrame([(1, "Two words"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode_decode(one, definition).select("doc_id", F.when(F.col("ids") != "", F.split("ids", " ").cast("array<int>")).otherwise(F.array().cast("array<int>")).alias("ids")), definition).collect()}
    assert rows[1].decoded == "two</w> words</w>" and rows[2].decoded == ""


# mixing


def test_mixing(spark, docs):
    rows = mixing.copies(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect())
    size, target, taken = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r.n_copies <= 3
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.n_copies * r.size
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        now = {s: 3 * size[s] if s in capped else left * weight[s] / free for s in names}
        more = {s for s in names if s not in capped and now[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    assert all(abs(now[s] - target[s]) < 1e-6 * max(1, now[s]) for s in names)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.copies(docs.repartition(3)).collect()))


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    got = mixing.copies(rows).groupBy("source").agg(F.sum(F.col("n_copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.02 for r in got)
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and mixed.count() == mixing.copies(rows).agg(F.sum("n_copies")).collect()[0][0]


def test_mixing_without_ids(spark):
    rows = spark.range(4000).selectExpr("IF(id % 3 = 0, id, NULL) doc_id", "concat(repeat('w ', 5 + CAST(id % 40 AS INT)), IF(id % 5 = 0, 'same', CAST(id AS STRING))) text", "IF(id % 4 = 0, 'a', 'b') source", "map('k', id % 2) extra")
    drawn = mixing.copies(rows).groupBy("source").agg(F.sum(F.col("n_copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    mixed = mixing.mix(rows)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    for r in drawn:
        assert abs(r.taken / r.target - 1) < 0.02 and got[r.source] == r.taken
    assert mixed.columns == rows.columns and mixed.drop("extra").exceptAll(rows.drop("extra").crossJoin(spark.range(3)).drop("id")).count() == 0


def test_mixing_of_nothing(no_docs):
    assert mixing.copies(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


# language


def test_language(spark, docs):
    import zlib

    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    known = {(r.doc_id, r.text): r.lang for r in docs.collect()}
    assert len(rows) == docs.count() and {r.lang_pred for r in rows} <= {"und", "en", "fr", "de", "es"}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) and 0 <= r.score <= 1
    lang = {k[0]: v for k, v in known.items() if k[0] is not None and k[0] >= 100}
    held = [(lang[r.doc_id], r.lang_pred) for r in rows if r.held_out and r.doc_id in lang]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    blank = {r.doc_id: r for r in rows if r.doc_id in (4, 5, 6)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in blank.values())
    again = language.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), model)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))


@pytest.mark.parametrize(("table", "columns"), [(language.TABLE, language.COLUMNS), (0, 0), (0, language.COLUMNS)])
def test_languages_in_scripts_above_3000(monkeypatch, table, columns):
    monkeypatch.setattr(language, "TABLE", table)
    monkeypatch.setattr(language, "COLUMNS", columns)
    rng = np.random.default_rng(6)
    ranges = {"zh": (0x4E00, 0x4F00), "zz": (0x4F00, 0x5000), "ja": (0x3041, 0x3090), "ko": (0xAC00, 0xAD00), "xx": (0x20000, 0x20100)}
    say = lambda lo, hi: " ".join("".join(chr(int(x)) for x in rng.integers(lo, hi, 5)) for _ in range(30))
    learn = [(x, say(*r)) for x, r in ranges.items() for _ in range(60)]
    model = language.StringKernel([t for _, t in learn], [x for x, _ in learn])
    held = [(x, say(*r)) for x, r in ranges.items() for _ in range(20)]
    found, _ = model.predict([t for _, t in held])
    assert sum(a == b for a, (b, _) in zip(found, held, strict=True)) >= 98
    plain = [{c.lower() for c in t if c.isalpha()} for _, t in held]
    assert all(len(model._held(t)) >= len(p) for (_, t), p in zip(held, plain, strict=True))


def test_language_sample_is_bounded(spark):
    # thousands of rows without an id, or with one id, in a language; texts longer than the bound
    rows = spark.range(6000).selectExpr("IF(id % 2 = 0, NULL, 3) doc_id", "concat('text number ', id, repeat(' more of it', CAST(id % 9 AS INT))) text", "IF(id % 3 = 0, 'en', 'de') lang")
    long = spark.range(2).selectExpr("100 + id doc_id", "repeat('lang ', 50000) text", "'fr' lang")
    everything = rows.unionByName(rows).unionByName(long)
    got = language.sample(everything, per_language=50, characters=60_000).collect()
    n = Counter(r.lang for r in got)
    assert n["en"] == n["de"] == 50 and "fr" not in n and len({(r.lang, r.text) for r in got}) == 100
    assert sum(len(r.text) for r in language.sample(everything, per_language=50, characters=3_000).collect()) <= 3_000
    rng = np.random.default_rng(1)
    say = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(30))
    docs = spark.createDataFrame([(None, say("abcdef"), "xx") for _ in range(300)] + [(3, say("defghi"), "yy") for _ in range(300)], "doc_id long, text string, lang string")
    rows = language.predict(docs, language.fit(docs, per_language=60)).collect()
    truth = {r.text: r.lang for r in docs.collect()}
    assert len(rows) == 600 and sum(r.lang_pred == ("xx" if r.doc_id is None else "yy") for r in rows) >= 590 and len(truth) == 600


def test_language_without_learning_rows(spark, no_docs, odd_docs):
    assert language.fit(no_docs) is None and language.predict(no_docs, None).collect() == []
    assert {r.lang_pred for r in language.predict(odd_docs, None).collect()} == {"und"}


# quality


def test_quality(spark, docs):
    junk = spark.createDataFrame([(900 + i, f"BUY{i}!! NOW!! " * 40) for i in range(30)] + [(950 + i, f"you are a worthless idiot and total scum number {i} in the end of it all") for i in range(30)], "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    everything = docs.select("doc_id", "text").unionByName(junk)
    rows = quality.classify(everything, quality.fit(everything, labels)).collect()
    assert len(rows) == everything.count() and all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in rows)
    out = {r.doc_id: r.rejected for r in rows if r.doc_id is not None}
    assert sum(out[i] for i in [*range(900, 930), *range(950, 980)]) >= 58
    clean = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    assert sum(out[i] for i in clean if i in out) <= 0.02 * len(clean)
    assert not out[7] and not out[11]


def test_quality_on_held_out_labels(spark):
    """Labels of even ids are learnt from, those of odd ids judge: clean documents stay, low quality goes, toxic texts that say something abusive go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(docs, quality.fit(docs, labels.filter("doc_id % 2 = 0")))
    judged = out.join(labels.filter("doc_id % 2 = 1").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")), "doc_id").join(docs, "doc_id").collect()
    abusive = {w for w in quality.ABUSE}
    part = lambda q, t: [r for r in judged if (r.q, r.t) == (q, t)]
    clean, low = part(1, 0), part(0, 0)
    toxic = [r for r in part(1, 1) if sum(w.strip(".,!?") in abusive for w in r.text.lower().split()) >= 3]
    assert len(clean) > 100 and sum(r.rejected for r in clean) <= 0.01 * len(clean)
    assert len(low) > 15 and sum(r.rejected for r in low) >= 0.95 * len(low)
    assert len(toxic) > 5 and sum(r.rejected for r in toxic) >= 0.95 * len(toxic)


def test_quality_does_not_depend_on_partitions(spark, docs):
    two = docs.select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = [Counter(map(tuple, quality.classify(x, quality.fit(x, labels)).collect())) for x in (two, two.repartition(7), two.orderBy(F.desc("text")))]
    assert scores[0] == scores[1] == scores[2]


def test_quality_leaves_other_languages_alone(spark, docs):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiouyäöklmnprstv"), int(rng.integers(3, 11)))) for _ in range(800)]
    other = spark.createDataFrame([(5000 + i, " ".join(rng.choice(words, 150)).capitalize() + ".") for i in range(40)], "doc_id long, text string")
    everything = docs.select("doc_id", "text").unionByName(other)
    out = quality.classify(everything, quality.fit(everything, None)).filter("doc_id >= 5000").collect()
    assert len(out) == 40 and sum(r.rejected for r in out) == 0


def test_quality_learns_from_equal_rows_once(spark):
    rows = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) doc_id", "IF(id % 2 = 0, 'the same text of nobody in particular', '### $$$ %%% ***') text")
    c = quality.fit(rows, None)
    out = {(r.text, r.rejected) for r in quality.classify(rows, c, carry=["text"]).collect()}
    assert len(out) == 2


def test_quality_without_rows(spark, no_docs):
    c = quality.fit(no_docs, None)
    assert quality.classify(no_docs, c).collect() == []
    one = spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")
    assert len(quality.classify(one, quality.fit(one, None)).collect()) == 2


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    right = [0.98, 0.9, 0.75]
    v = np.zeros((20_000, quality.N_HEURISTICS + 1), dtype=np.int64)
    for k, a in enumerate(right):
        said = np.where(rng.random(20_000) < a, truth, ~truth)
        v[:, k] = np.where(said, quality.BAD, quality.GOOD)
    patterns, n = np.unique(quality.pattern(v), return_counts=True)
    model = quality.LabelModel(patterns, n.astype(float), v.shape[1])
    assert model.accuracy[0].mean() > model.accuracy[1].mean() > model.accuracy[2].mean()
    assert ((model.posterior(v) > 0.5) == truth).mean() > 0.95


def test_label_model_by_plain_loops():
    """Expectation-maximisation, row by row and class by class."""
    rng = np.random.default_rng(4)
    v = rng.integers(0, 3, (90, quality.N_HEURISTICS + 1))
    v[:40] = np.where(v[:40] == quality.BAD, quality.GOOD, v[:40])
    patterns, n = np.unique(quality.pattern(v), return_counts=True)
    model = quality.LabelModel(patterns, n.astype(float), v.shape[1], rounds=25)
    meant, M = [*quality.LABELLERS.values(), None], quality.LabelModel
    start = [[M.FOUND if meant[j] == k or (meant[j] is None and k) else M.BLAMED for j in range(v.shape[1])] for k in range(4)]
    blame, share, pseudo = [list(x) for x in start], list(M.SHARES), M.PRIOR * len(v) + 1

    def chances(row):
        p = list(share)
        for k in range(4):
            for j, x in enumerate(row):
                p[k] *= blame[k][j] if x == quality.BAD else 1 - blame[k][j] if x == quality.GOOD else 1
        return [x / sum(p) for x in p]

    for _ in range(25):
        each = [chances(row) for row in v]
        for k in range(4):
            for j in range(v.shape[1]):
                bad = sum(e[k] for e, row in zip(each, v, strict=True) if row[j] == quality.BAD) + pseudo * start[k][j]
                good = sum(e[k] for e, row in zip(each, v, strict=True) if row[j] == quality.GOOD) + pseudo * (1 - start[k][j])
                blame[k][j] = bad / (bad + good)
        share = [(sum(e[k] for e in each) + pseudo * M.SHARES[k]) / (len(v) + pseudo) for k in range(4)]
    assert np.allclose(model.chance[:, :, 1], blame) and np.allclose(model.share, share)
    assert np.allclose(model.posterior(v), [1 - chances(row)[0] for row in v])


def test_lessons_by_plain_counts(spark):
    """Words of toxic documents and odds of trigrams, counted one document at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    worst = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    lessons = quality.teach(docs, worst)
    held, size, grams = {"toxic": Counter(), "other": Counter()}, Counter(), {"low": Counter(), "clean": Counter()}
    for r in docs.join(worst, "doc_id").collect():
        raw = (r.text or "").encode()
        side = "toxic" if r.toxic == 1 else "other"
        held[side].update(set(raw.translate(quality._SPLIT).split()))
        size[side] += 1
        if r.toxic == 0:
            c = [int(quality._CLASS[b]) for b in raw]
            grams["low" if r.quality == 0 else "clean"].update(zip(c, c[1:], c[2:], strict=False))
    want, t, o = [], size["toxic"], size["other"]
    for w, a in held["toxic"].items():
        b = held["other"][w]
        g = 2 * sum(x * np.log(x / (n * (a + b) / (t + o))) for x, n in ((a, t), (b, o)) if x)
        if (a + 0.5) / (t + 1) >= quality.TIMES * (b + 0.5) / (o + 1) and g >= quality.EVIDENCE:
            want.append(w)
    assert len(want) > 5 and set(lessons.words.tolist()) == set(quality.word_hashes(want)[0].tolist())
    total = {k: sum(x.values()) + quality.TRIGRAMS for k, x in grams.items()}
    odds = [np.log((grams["low"][g] + 1) / total["low"]) - np.log((grams["clean"][g] + 1) / total["clean"]) for g in np.ndindex(8, 8, 8)]
    assert np.allclose(lessons.odds, odds)


def test_quality_query(spark):
    """The registered query: scores worked out one column at a time; labellers that differ in what they are worth; most toxic documents of every language go."""
    got = {r.doc_id: r for r in quality.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    c = quality.fit(docs, labels)
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::7]:
        columns = quality.features(*quality.measure([r.text], c.lessons))[0]
        words = len(columns) - len(quality.STATISTICS)
        z = float(c.weights[-1]) + sum(float(c.weights[x]) * (1 / max(1, words) ** 0.5 if k < words else 1.0) for k, x in enumerate(columns))
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-4 and got[r.doc_id].rejected == (got[r.doc_id].score >= quality.REJECT)
    assert np.ptp(c.model.accuracy) > 0.05
    toxic = [r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 AND t = 1").collect()]
    assert sum(got[i].rejected for i in toxic) >= 0.7 * len(toxic)


def test_language_query_by_plain_sets(spark):
    """The registered query against kernels of Python sets, and ridge regression by least squares."""
    got = {r.doc_id: r for r in language.op10_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    fitted = sorted((r.lang, r.h, r.text) for r in language.sample(docs).collect())
    names = sorted({x for x, _, _ in fitted})
    marks = [t for x in names for t in [t for y, _, t in fitted if y == x][: 160 // len(names)]]

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        s, before = " ", None
        for c in letters:
            if c != " " or before != " ":
                s += c
            before = c
        s += " "
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    seen = set().union(*map(grams, marks))
    held = [grams(t) for t in marks]
    kernel = lambda texts: np.array([[len(g & m) / (max(1, len(g)) * max(1, len(m))) ** 0.5 for m in held] for g in (grams(t) & seen for t in texts)])
    values, vectors = np.linalg.eigh(kernel(marks))
    root = (vectors / np.sqrt(np.maximum(values, 1e-12)))[:, values > 1e-6 * values[-1]]
    x = np.hstack([kernel([t for _, _, t in fitted]) @ root, np.ones((len(fitted), 1))])
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a, _, _ in fitted])
    w = np.linalg.lstsq(np.vstack([x, (1e-3 * len(x)) ** 0.5 * np.eye(x.shape[1])]), np.vstack([y, np.zeros((x.shape[1], len(names)))]), rcond=None)[0]
    rows = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    f = np.hstack([kernel([r.text for r in rows]) @ root, np.ones((len(rows), 1))]) @ w
    e = np.exp(4 * f)
    assert len(got) == docs.count() and len(rows) > 150
    for r, a, b in zip(rows, f, e / e.sum(1, keepdims=True), strict=True):
        assert got[r.doc_id].lang_pred == names[a.argmax()] and abs(got[r.doc_id].score - b.max()) < 2e-3
