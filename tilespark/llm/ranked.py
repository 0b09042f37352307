"""Ranked lexical search by presence masks: exact best documents of each item under an integer BM25.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. Documents are read once for each block of items and
become postings of the block's terms: rows of up to ``DOCS`` documents with, for each term, the documents that hold it and how often. The postings are written
to the shared folder; document counts and weights come from them.

Within a row of postings each term has a bitmap of documents. An item's bitmaps are laid over each other and turned, which gives every document the mask
of the item's terms that it holds; documents are grouped by mask, and a mask's maximum score is the sum of its terms' best contributions in these documents.
Masks are evaluated from the highest maximum down, until an item has its ``top`` documents and the next maximum is below the last of them: whatever is left cannot
enter. A task carries its best from row to row and returns ``top`` documents an item, of which a window picks the final ones.

Items are a query set: they go to the tasks in blocks of about ``ITEM_CHARS`` characters (an item's text is never parted), so that what is sent does not grow with
their number; documents are never sent or gathered.

Defined cases: null texts have no terms; every row of either table is a document or an item of its own, whatever its id, so repeated rows rank beside each other; ties go by
ascending doc_id, null ids last; an item without terms or matches has no rows; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.shared import bounded_batches, materialize

#: Documents and postings in one row of postings, at most (but for the last document's own).
DOCS, POSTINGS = 8_192, 2_000_000
#: Characters of items that are sent to the tasks at once, about.
ITEM_CHARS = 2_000_000
#: Documents evaluated together: masks are taken from the highest maximum down until they hold so many.
TOGETHER = 64
#: Bytes of a text that are cut into terms at once.
CUT = 1 << 20
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

BLOCKS = "seen long, total long, docs array<long>, lengths binary, terms binary, starts binary, places binary, times binary"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``CUT`` bytes."""
    raw = (text or "").encode().translate(TERM_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + CUT)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _postings(vocabulary):
    """Batches of (doc_id, text) become rows of postings of the vocabulary's terms."""

    def block(seen, total, docs, lengths, terms, places, times):
        terms, places, times = (np.array(x, np.int32) for x in (terms, places, times))
        order = np.lexsort((places, terms))
        held, starts = np.unique(terms[order], return_index=True)
        raw = [np.array(lengths, np.int64), held, starts.astype(np.int32), places[order], times[order]]
        columns = [pa.array([seen], pa.int64()), pa.array([total], pa.int64()), pa.array([docs], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in raw]]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        keys = known.keys()
        seen = total = 0
        docs, lengths, terms, places, times = [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                counts: Counter = Counter()
                n = 0
                for part in terms_of(text.as_py()):
                    counts.update(part)
                    n += len(part)
                if not n:
                    continue
                seen, total = seen + 1, total + n
                held = keys & counts.keys()
                if held:
                    terms += [known[t] for t in held]
                    times += [counts[t] for t in held]
                    places += [len(docs)] * len(held)
                    docs.append(doc_id.as_py())
                    lengths.append(n)
                if len(docs) >= DOCS or len(terms) >= POSTINGS:
                    yield block(seen, total, docs, lengths, terms, places, times)
                    seen = total = 0
                    docs, lengths, terms, places, times = [], [], [], [], []
        if seen:
            yield block(seen, total, docs, lengths, terms, places, times)

    return run


def _held(size: int):
    """How many documents hold each term, over a task's rows of postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for terms, starts, n in zip(batch["terms"].to_pylist(), batch["starts"].to_pylist(), batch["n"].to_pylist(), strict=True):
                held[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(starts, np.int32), append=n)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["term", "held"])

    return run


def grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of mask words: the rows in an order that keeps equal masks together, and where each group starts."""
    order = np.lexsort(masks.T[::-1]) if masks.shape[1] > 1 else np.argsort(masks[:, 0], kind="stable")
    inorder = masks[order]
    starts = np.flatnonzero(np.r_[True, (inorder[1:] != inorder[:-1]).any(axis=1)]) if len(masks) else np.zeros(0, np.int64)
    return order, starts


class Row:
    """One row of postings, with contributions and bitmaps of its terms."""

    def __init__(self, docs, lengths, terms, starts, places, times, weights: np.ndarray, n: int, total: int):
        lengths = np.frombuffer(lengths, np.int64)
        self.places, times = np.frombuffer(places, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
        held, self.starts = np.frombuffer(terms, np.int32), np.frombuffer(starts, np.int32)
        self.at = {t: k for k, t in enumerate(held.tolist())}
        self.ends = np.append(self.starts[1:], len(self.places))
        self.size = len(docs)
        self.nobody = np.array([d is None for d in docs], bool)
        self.docs = np.array([0 if d is None else d for d in docs], np.int64)
        m = 100 - 25 + (25 * lengths * n) // total
        weight = np.repeat(weights[held], self.ends - self.starts)
        self.gains = weight * ((1_000_000_000 * times) // (1000 * times + 12 * m[self.places]))
        self.most = np.maximum.reduceat(self.gains, self.starts) if len(held) else np.zeros(0, np.int64)
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, k: int) -> np.ndarray:
        found = self.bitmaps.get(k)
        if found is None:
            bits = np.zeros(self.size, np.uint8)
            bits[self.places[self.starts[k] : self.ends[k]]] = 1
            found = self.bitmaps[k] = np.packbits(bits)
        return found

    def search(self, item: list[tuple[int, int]], best: tuple[np.ndarray, np.ndarray, np.ndarray], top: int):
        """``best`` (scores, without id, ids) of an item, best first, with what this row adds."""
        held = [(self.at[t], q) for t, q in item if t in self.at]
        if not held:
            return best
        ks, qs = np.array([k for k, _ in held]), np.array([q for _, q in held], np.int64)
        gains = qs * self.most[ks]
        last = int(best[0][-1]) if len(best[0]) == top else 1
        if int(gains.sum()) < last:
            return best
        words = -(-len(held) // 64)
        over = np.zeros((64 * words, self.size), np.uint8)
        over[: len(held)] = np.unpackbits(np.stack([self.bitmap(k) for k in ks]), axis=1, count=self.size)
        masks = np.ascontiguousarray(np.packbits(over, axis=0).T).view(np.uint64)
        order, starts = grouped(masks)
        bounds = over[: len(held), order[starts]].T.astype(np.int64) @ gains
        ends = np.append(starts[1:], len(order))
        by_bound = np.argsort(-bounds, kind="stable")
        at = 0
        while at < len(by_bound) and bounds[by_bound[at]] >= last:
            chosen, size = [], 0
            while at < len(by_bound) and size < TOGETHER and bounds[by_bound[at]] >= last:
                g = by_bound[at]
                chosen.append(order[starts[g] : ends[g]])
                size, at = size + len(chosen[-1]), at + 1
            docs = np.sort(np.concatenate(chosen))
            scores = np.zeros(len(docs), np.int64)
            for j, k in enumerate(ks):
                hit = np.flatnonzero(over[j, docs])
                if len(hit):
                    where = self.starts[k] + np.searchsorted(self.places[self.starts[k] : self.ends[k]], docs[hit])
                    scores[hit] += qs[j] * self.gains[where]
            keep = scores >= last
            best = kept(*(np.concatenate(x) for x in zip(best, (scores[keep], self.nobody[docs[keep]], self.docs[docs[keep]]), strict=True)), top)
            last = int(best[0][-1]) if len(best[0]) == top else 1
        return best


def kept(scores: np.ndarray, nobody: np.ndarray, docs: np.ndarray, top: int):
    """The ``top`` best by score, then id, those without an id last."""
    order = np.lexsort((docs, nobody, -scores))[:top]
    return scores[order], nobody[order], docs[order]


def _ranked(sent, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n, total = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * len(items)
        names = ["docs", "lengths", "terms", "starts", "places", "times"]
        for batch in batches:
            for values in zip(*(batch[c] for c in names), strict=True):
                row = Row(*(v.as_py() for v in values), weights, n, total)
                for i, item in enumerate(items):
                    best[i] = row.search(item, best[i], top)
        sizes = [len(b[0]) for b in best]
        scores, nobody, docs = (np.concatenate([b[k] for b in best] or [none[k]]) for k in range(3))
        columns = [pa.array(np.repeat(np.arange(len(items)), sizes), pa.int64()), pa.array(docs, pa.int64(), mask=nobody), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def search_block(documents: DataFrame, items: list[tuple[int | None, str | None]], top: int) -> DataFrame:
    """``item, doc_id, score``: at least the ``top`` best documents of each item, numbered by its place in the list."""
    spark = documents.sparkSession
    terms: dict[bytes, int] = {}
    asked = [[(terms.setdefault(t, len(terms)), q) for t, q in sum((Counter(p) for p in terms_of(text)), Counter()).items()] for _, text in items]
    vocabulary = spark.sparkContext.broadcast(terms)
    bounded_batches(spark)
    postings = materialize(documents.select("doc_id", "text").mapInArrow(_postings(vocabulary), BLOCKS), "postings")
    n, total = postings.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    counts = postings.select("terms", "starts", (F.length("places") / 4).cast("long").alias("n")).mapInArrow(_held(len(terms)), "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    weights = np.zeros(len(terms), np.int64)
    for term, held in counts.collect():  # at most the block's terms
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * held + 1)))
    sent = spark.sparkContext.broadcast((asked, weights, n, total))
    return postings.drop("seen", "total").mapInArrow(_ranked(sent, top), "item long, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, top: int = 20, item_chars: int = ITEM_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // item_chars) or 1
    found = None
    for b in range(blocks):
        some = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).collect()]
        if not some:
            continue
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(some)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = search_block(documents, some, top).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0) if found is None else found


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
stat AS (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(coalesce(sum(len(ts)), 0) AS BIGINT) AS l FROM docs),
tfs AS MATERIALIZED (SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, 75 + (25 * len(ts) * s.n) // s.l AS m, unnest(ts) AS term FROM docs, stat s WHERE len(ts) > 0) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
  SELECT i, item_id, term, count(*) AS q FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(q * CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN dfs USING (term) JOIN tfs USING (term), stat s GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""

QUERIES = {"op12_ranked": op12_ranked}
ORACLE = {"op12_ranked": OP12_SQL}
