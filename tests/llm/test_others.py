"""Vectors, archives, conversations and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.llm import catalog, chat, multi_index, warc

SF = "/root/testdata/sf0.001"


# inverted multi-index


def brute(rows, top=5):
    """All neighbours of usable vectors whose id is divisible by 50."""
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for i, v in good:
        if i % 50 == 0:
            score = {}
            for j, w in good:
                if j != i:
                    a, b = np.array(v), np.array(w)
                    score[j] = max(score.get(j, -2), float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))))
            out[i] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:top]
    return out


def test_whole_search_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [rows[50], rows[50], (None, rows[1][1]), (7001, None), (7002, [0.0] * 8), (7003, [float("nan")] * 8), (7004, [1.0, None] * 4), (7005, [1.0] * 3), (7006, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], "vec_id long, embedding array<double>, vec string, cell int")
    index = multi_index.MultiIndex(df, k=6, share=1.0)
    got = {}
    for r in index.search(index.rows.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [x[:2] for x in sorted(found)] == [(k + 1, v) for k, (v, _) in enumerate(want[q])]
        assert np.allclose([x[2] for x in sorted(found)], [s for _, s in want[q]], atol=1e-12)


def test_very_large_and_very_small_vectors(spark):
    """A vector's size does not count, down to the smallest numbers and up to the largest."""
    rng = random.Random(9)
    plain = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    factor = {0: 1e200, 50: 1e-200, 100: 1e-300, 3: 1e307, 4: 5e-300, 7: 1e250, 9: 1e-250}
    index = multi_index.MultiIndex(spark.createDataFrame([(i, [x * factor.get(i, 1.0) for x in v]) for i, v in plain], "vec_id long, embedding array<double>"), k=4, share=1.0)
    got = {}
    for r in index.search(index.rows.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(plain)
    assert got.keys() == want.keys() == {0, 50, 100}
    for q, found in got.items():
        assert [x[1] for x in sorted(found)] == [v for v, _ in want[q]] and np.allclose([x[2] for x in sorted(found)], [s for _, s in want[q]], atol=1e-12)


def test_recall(spark):
    found = {}
    for r in multi_index.op1_multi_index(spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(e["embedding"].tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = e["vec_id"].to_numpy()
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        hits.append(len(set(ids[np.argsort(-s)[:5]]) & found[ids[i]]) / 5)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_many(spark, clustered):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(10_000, 32))
    if clustered:
        x = rng.normal(size=(100, 32))[rng.integers(0, 100, 10_000)] + 0.25 * x
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    index = multi_index.MultiIndex(df)
    found = {}
    for r in index.search(index.rows.filter("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = []
    for i in range(0, 10_000, 50):
        s = u @ u[i]
        s[i] = -2
        hits.append(len(set(np.argsort(-s)[:5].tolist()) & found[i]) / 5)
    assert np.mean(hits) >= 0.9
    assert index.share < (0.15 if clustered else 0.7)


def test_no_vectors_and_one(spark):
    for rows in ([], [(50, [1.0, 2.0])]):
        index = multi_index.MultiIndex(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert index.search(index.rows.filter("vec_id % 50 = 0")).collect() == []


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b, n = rng.random(7), rng.random(5), rng.integers(0, 3, 35)
    cells = multi_index.visit_order(a, b, n, int(n.sum()))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums) and set(cells) == set(np.flatnonzero(n).tolist())


# archives


def test_archive(spark, tmp_path):
    rows = [(i, f"http://a/{i}\r\nX: 1", "body %d " % (i % 7) * 40) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "short"), (103, "u", "short"), (None, "u", "body 1 " * 40), (5, "http://a/5", "body 5 " * 40), (104, "é", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, frame int").repartition(3)
    path = f"file://{tmp_path}/a"
    warc.write_archive(warc.records_of(pages), path)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h in first and (i is None or i > first[h])
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None, None if again else raw)] += 1
    got = warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
    assert Counter((*r[:5], None if r[5] is None else bytes(r[5])) for r in got) == want
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-")]
    seen = 0
    for f in files:
        raw = f.read_bytes()
        reads = []

        def read_at(o, n, raw=raw, reads=reads):
            reads.append(n)
            return raw[o : o + n]

        reader = warc.BundleReader(read_at, len(raw))
        for page_id, *_ in reader.index:
            if page_id == 17:
                before = len(reads)
                assert reader.record(17)["payload"] in (b"", ("body 3 " * 40).encode())
                assert len(reads) == before + 1
                seen += 1
        # any reader takes the file from front to back
        plain = warc.zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == len(reader.index)
    assert seen == 1


def test_archive_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).collect() == []


# conversations


def test_chat_round_trip(spark):
    odd = ["", "plain", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\<|", "<", "|>", "ends with \\", "<\\|im_sep|>", "\n\n", "😀 <|im_sep|>", None]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool\nx", "a\\n", None, "sys<|tem"]), rng.choice(odd), "x") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, None, "user", "no turn", "x"), (50, 0, "user", "same", "x"), (50, 0, "user", "same", "x"), (None, 1, "assistant", "lost", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(5)
    back = {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    grouped = {}
    for c, t, role, text, _ in rows:
        grouped.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert back.keys() == grouped.keys()
    for c, turns in grouped.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert [(t.role, t.text) for t in back[c].turns] == [x[2:] for x in turns]
        assert back[c].loss_text == "".join(x[3] for x in turns if x[2] == "assistant")
    merged = chat.format_conversations(df).filter("conv_id = 50").collect()[0].formatted
    assert merged.count("<|im_start|>") == 1 and merged.count("<|im_sep|>") == 2


def test_chat_takes_time_in_proportion_to_turns(spark):
    import time

    def seconds(n):
        text = F.concat(F.lit("é"), F.repeat(F.lit("word "), (F.col("id") % 60).cast("int")), F.lit("<|"))
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
        began = time.perf_counter()
        out = chat.parse_conversations(chat.format_conversations(rows)).collect()[0]
        took = time.perf_counter() - began
        assert out.loss_text == "".join("é" + "word " * (i % 60) + "<|" for i in range(n) if i % 3)
        return took

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.2)


def test_running_sums(spark):
    for n in (0, 1, 5, 64, 65, 200):
        got = spark.range(1).select(chat.running_sum(F.array(*[F.lit(i % 7) for i in range(n)]).cast("array<bigint>")).alias("s")).collect()[0].s
        assert got == np.cumsum([i % 7 for i in range(n)]).tolist()


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse_conversations(chat.format_conversations(none)).collect() == []


# all together


def test_catalogue():
    names = [n.split("_")[0] for n in catalog.queries()]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd_docs, no_docs):
        docs = start
        before = None
        for name, stage in p.STAGES:
            out = stage(spark, docs, str(tmp_path)).cache()
            if name != "bpe":
                assert out.columns == start.columns and [f.dataType for f in out.schema] == [f.dataType for f in start.schema]
                assert out.filter("_row <> 'own' OR id <> 7").count() == 0
            if name in ("quality classifier", "near-duplicates"):
                assert out.exceptAll(docs).count() == 0
            if name == "repeated passages":
                assert out.count() == docs.count()
            before, docs = docs, out
        assert "ids" in docs.columns and docs.count() == before.count()


def test_pipeline_decodes(spark, odd_docs):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from tilespark.llm import bpe

    t = Tokenizer.from_str(bpe.default_definition())
    want = Counter()
    for r in odd_docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, r.source, len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))] += 1
    out = p.encode(spark, odd_docs, "")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"] and Counter(map(tuple, out.collect())) == want


def test_pipeline_near_duplicates_keep_one(spark, odd_docs):
    import corpus_pipeline as p

    kept = p.drop_near_duplicates(spark, odd_docs.filter("doc_id IN (1, 2, 3, 11)"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 11]
    twins = odd_docs.filter("doc_id = 2")
    assert p.drop_near_duplicates(spark, twins, "").count() == 1


def test_pipeline_near_duplicates_lose_no_text(spark, odd_docs):
    """Texts that share an id, or have none, are documents of their own."""
    import corpus_pipeline as p

    say = lambda seed: " ".join(f"word{seed}x{j}" for j in range(60))
    texts = [(3, say(1)), (5, say(1) + " more"), (5, say(2)), (5, say(2)), (None, say(3)), (None, say(3) + " more"), (None, say(2) + " more"), (9, say(3) + " again"), (None, say(4)), (None, None), (None, ""), (7, None)]
    rows = [(i, t, "en", "a", 1, 0.5, "own", 7, 1) for i, t in texts]
    kept = p.drop_near_duplicates(spark, spark.createDataFrame(rows, odd_docs.schema), "")
    assert kept.columns == odd_docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(3, say(1)), (5, say(2)), (9, say(3) + " again"), (None, say(4)), (None, None), (None, ""), (7, None)])


def test_pipeline_removes_what_repeats(spark, odd_docs):
    import corpus_pipeline as p

    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"start {i} of it " + " ".join(f"own{i}x{j}" for j in range(80)) + " " + passage + f" end {i}", "en", "a", 1, 0.5, "own", 7, 1) for i in range(3)]
    out = p.cut_repeats(spark, spark.createDataFrame(rows, odd_docs.schema), "").collect()
    assert all("shared30" not in r.text and f"own{r.doc_id}x40" in r.text and r.n_chars == len(r.text) for r in out)


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small corpus against plain Python: the classifier as fitted, groups over all pairs, all windows, draws by the targets, the tokenizer itself."""
    import random

    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from tilespark.llm import bpe, mixing, quality

    rng = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.filter("doc_id < 90").collect()
    extra = [(1000 + i, kept[i].text + f" tail{i}", kept[i].lang, rng.choice(["x", "y", None]), 0) for i in range(0, 30, 3)]
    spark.createDataFrame([tuple(r) for r in kept] + extra, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.classify(table, quality.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))).filter("NOT rejected").collect()}
    rows = {r.doc_id: r for r in table.collect() if r.doc_id in good}

    def shingles(text):
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, up = {i: shingles(r.text) for i, r in rows.items()}, {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (both := len(sets[i] & sets[j])) and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    rows = {i: r for i, r in rows.items() if root(i) == i}
    seen = Counter(b[k : k + 200] for r in rows.values() for b in [(r.text or "").encode()] for k in range(len(b) - 199))
    texts = {}
    for i, r in rows.items():
        b = (r.text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        texts[i] = None if r.text is None else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    cut = spark.createDataFrame([(i, t, rows[i].source) for i, t in texts.items()], "doc_id long, text string, source string")
    drawn = {r.doc_id: r.n_copies for r in mixing.copies(cut).collect()}  # itself held against targets worked out one by one
    t, want = Tokenizer.from_str(bpe.default_definition()), Counter()
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[(i, rows[i].source, len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))] += drawn[i]
    got = Counter(map(tuple, p.run(spark, str(tmp_path)).collect()))
    assert got == +want and len(texts) < len(good) < 100


@pytest.mark.parametrize("name", ["op2_warc", "op4_neardup", "op8_mixing", "op9_chat"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = Counter(tuple(round(x[i], 6) if isinstance(x[i], float) else x[i] for i in at) for x in r.fetchall())
    assert Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in df.select(*cols).collect()) == want


def test_op9_marker_conversation(spark):
    row = [r for r in chat.op9_chat(spark, SF).collect() if r.conv_id == -1][0]
    assert row.n_turns == 2 and row.loss_chars == len(chat.MARKER_TEXT) and row.loss_sha256 == hashlib.sha256(chat.MARKER_TEXT.encode()).hexdigest()


def test_lineage_is_cut_in_the_shared_folder(spark):
    from tilespark.llm.shared import materialize, table_bytes

    df = materialize(spark.range(10).select(F.col("id").alias("weird na`me")), "t")
    assert df.count() == 10 and table_bytes(df) > 0


def test_tasks_give_back_what_they_freed():
    import re
    from pathlib import Path

    from tilespark.llm.shared import tidy

    def megabytes():
        return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    kept = []

    def run(batches):
        held = [bytes(5000) for _ in range(40_000)]  # 200 MB, in pieces that are kept when freed
        kept.append(bytes(5000))  # behind them
        yield from batches
        del held

    before = megabytes()
    assert list(tidy(run)(iter([1, 2]))) == [1, 2]
    assert megabytes() - before < 60
