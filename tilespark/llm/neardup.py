"""Near-duplicate detection: fast similarity sketches, banding, exact verification, connected components.

1. Every text becomes the set of its hashed shingles; sets give a digest and, through their sketches, band keys. Equal sets are one class from here on,
   represented by the smallest id, so that thousands of copies cost as much as one.
2. Classes that share a band key are candidates. Buckets emit stars (member to least member), never pairs; their components
   hold every pair that shares a key, so links are only to be sought inside candidate components.
3. Links are confirmed on full sets inside a candidate component. A component that fits in a task is searched there. A larger one is dealt by hash
   into blocks, twice by different hashes, and each block is searched by itself: that joins what is thickly linked, such as thousands of near-copies.
4. What then lies in one candidate component but is not connected is looked at through its rarest shingles: sets as alike as asked share one of the
   first ``size - ceil(threshold * size) + 1`` of their shingles, rarest in the component first. Only sets that share one with another part can have a link
   left; a family of texts that share a frame and little else has none, however large. Those sets are searched block by block, the largest part
   against the others only. No link is lost here.

Tasks emit spanning edges, not pairs, and a pair whose link could only repeat a known connection is not looked at again.

The chance that a pair at the threshold shares no band key is below 1e-6 (see ``bands_for``), and it is only lost if
no third text connects the two either.

Defined cases: a set of no words is empty and linked with nothing; null text is empty; rows that share an id are one document, whatever their texts;
rows without an id are linked with nothing, have no component and are kept; ties go to the smaller id; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.components import Forest, connected_components
from tilespark.llm.shared import bounded_batches, join_small, materialize, partitions, tidy
from tilespark.llm.shingles import band_keys, bands_for, shingle_sets, sketches

#: Hashes a block holds, about; a component up to this size is searched in one go. Texts hashed at a time, in characters.
BLOCK_HASHES, PIECE_CHARS = 100_000, 400_000


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts in runs of bounded size."""
    texts, first, chars = [], 0, 0
    column = batch.column("text")
    for i in range(batch.num_rows):
        t = column[i].as_py()
        texts.append(t)
        chars += len(t or "")
        if chars > PIECE_CHARS or len(texts) >= 1000:
            yield first, texts
            texts, first, chars = [], i + 1, 0
    if texts:
        yield first, texts


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """``doc_id, n_shingles, digest, keys``; digest and keys are null for empty sets."""
    bands, rows = bands_for(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch):
                sets = shingle_sets(texts, k)
                keys = band_keys(sketches(sets), bands, rows).astype(np.int64)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array([x.tolist() if len(s) else None for x, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(sign), "doc_id long, n_shingles long, digest binary, keys array<long>")


def links_within(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions (in ``sets``, or in ``sets`` and ``others``) with 100 * intersection >= percent * union.

    Intersections are counted through an inverted list of hashes: one count of list members for every set.
    """
    index = others if others is not None else sets
    sizes = np.array([len(x) for x in index])
    if not len(sizes) or not len(sets):
        return
    flat, owner = np.concatenate(index), np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = hi - lo
        lo, n = lo[n > 0], n[n > 0]
        if not len(lo):
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(index))
        linked = 100 * both >= percent * (len(s) + sizes - both)
        linked &= both > 0
        if others is None:
            linked[: i + 1] = False
        for j in np.flatnonzero(linked).tolist():
            yield i, j


def _set(raw) -> np.ndarray:
    return np.frombuffer(raw.as_py(), dtype=np.uint64)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], ["a", "b"])


def _search(percent: int):
    """A function over rows ``task, side, doc_id, set`` sorted by task: spanning edges of the links of each task.

    Side 0 alone is searched within itself; with a side 1, side 0 is also searched against it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(ids: list[list[int]], sets: list[list[np.ndarray]], within: bool) -> list[tuple[int, int]]:
            forest, found = Forest(), []
            if within:
                for i, j in links_within(sets[0], None, percent):
                    if forest.join(ids[0][i], ids[0][j]):
                        found.append((ids[0][i], ids[0][j]))
            if ids[1]:
                for i, j in links_within(sets[0], sets[1], percent):
                    if forest.join(ids[0][i], ids[1][j]):
                        found.append((ids[0][i], ids[1][j]))
            return found

        task, ids, sets, within, found = None, [[], []], [[], []], True, []
        for batch in batches:
            t, side, docs, raw, inner = (batch.column(c) for c in ("task", "side", "doc_id", "set", "within"))
            for i in range(batch.num_rows):
                if (now := t[i].as_py()) != task:
                    if task is not None:
                        found += solve(ids, sets, within)
                    task, ids, sets, within = now, [[], []], [[], []], inner[i].as_py()
                k = side[i].as_py()
                ids[k].append(docs[i].as_py())
                sets[k].append(_set(raw[i]))
            if len(found) > 100_000:
                yield _edges(found)
                found = []
        if task is not None:
            found += solve(ids, sets, within)
        yield _edges(found)

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each hash of each set."""
    for batch in batches:
        for i in range(batch.num_rows):
            h = _set(batch.column("set")[i]).view(np.int64)
            same = [np.full(len(h), batch.column(c)[i].as_py(), dtype=np.int64) for c in ("component", "label", "giant", "doc_id")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, np.full(len(h), len(h)), h)], ["component", "label", "giant", "doc_id", "size", "h"])


def searched(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning edges of the links of each task of ``task, side, within, doc_id, set``."""
    dealt = rows.select("task", "side", "within", "doc_id", "set").repartition(max(partitions(rows.sparkSession), 2), "task").sortWithinPartitions("task", "side")
    return dealt.mapInArrow(tidy(_search(percent)), "a long, b long")


def possible(sets: DataFrame, percent: int) -> DataFrame:
    """``doc_id`` of the sets (``component, label, giant, doc_id, set``) that share one of their rarest hashes with a set of another label, as linked sets must.

    Hashes are counted by partial aggregation and joined back; no pair is made.
    """
    hashes = sets.mapInArrow(tidy(_hashes), "component long, label long, giant long, doc_id long, size long, h long")
    often = hashes.groupBy("component", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = hashes.join(often, ["component", "h"])
    # hashes that nobody shares come first and find nothing: they only use up places
    mine = Window.partitionBy("doc_id")
    place = F.row_number().over(mine.orderBy("n", "h")) + F.col("size") - F.count(F.lit(1)).over(mine)
    needed = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rare = materialize(shared.withColumn("place", place).filter(F.col("place") <= needed).select("component", "h", "doc_id", "label"), "rare")
    met = rare.groupBy("component", "h").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("component", "h")
    return rare.join(met, ["component", "h"], "left_semi").select("doc_id").distinct()


def links_between(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: edges that span the links between sets (``component, label, giant, doc_id, set``) of one component and different labels.

    Sets that can have such a link are searched block by block: those of the label ``giant``, usually most, against the others only, being linked among
    themselves. Tasks hold two blocks.
    """
    left = materialize(sets.join(materialize(possible(sets, percent), "possible"), "doc_id", "left_semi"), "unsettled-left")
    sizes = left.groupBy("component").agg(F.sum(F.when(F.col("label") == F.col("giant"), F.length("set") / 8).otherwise(0)).alias("n"), F.sum(F.length("set") / 8).alias("all"))
    sizes = materialize(sizes.select("component", F.ceil(F.col("n") / BLOCK_HASHES).cast("int").alias("g"), F.ceil((F.col("all") - F.col("n")) / BLOCK_HASHES).cast("int").alias("r")), "blocks")
    sided = join_small(left, sizes, "component", "inner").filter("r > 0").withColumn("in_giant", F.col("label") == F.col("giant"))
    h = F.xxhash64("doc_id")
    mine = F.when(F.col("in_giant"), F.pmod(h, F.greatest("g", F.lit(1)))).otherwise(F.pmod(h, F.col("r"))).cast("int")
    every = F.sequence(F.lit(0), F.col("r") - 1)
    # tasks: (i, i) and (i, j) among blocks of the rest, (i, g:j) between a block of the rest and one of the largest part
    to = lambda name, side, within: F.struct(name.alias("t"), side.alias("side"), within.alias("within"))
    against = F.when(F.col("g") > 0, F.transform(F.sequence(F.lit(0), F.greatest("g", F.lit(1)) - 1), lambda j: to(F.concat_ws(":", F.col("mine"), F.lit("g"), j), F.lit(0), F.lit(False)))).otherwise(F.array().cast("array<struct<t:string,side:int,within:boolean>>"))
    among = F.transform(every, lambda i: to(F.concat_ws(":", F.least(i, F.col("mine")), F.greatest(i, F.col("mine"))), F.when(i >= F.col("mine"), 0).otherwise(1), i == F.col("mine")))
    goes = F.when(F.col("in_giant"), F.transform(every, lambda i: to(F.concat_ws(":", i, F.lit("g"), F.col("mine")), F.lit(1), F.lit(False)))).otherwise(F.concat(among, against))
    rows = sided.withColumn("mine", mine).select("component", "doc_id", "set", F.explode(goes).alias("_g"))
    return searched(rows.select(F.concat_ws(":", "component", "_g.t").alias("task"), F.col("_g.side").alias("side"), F.col("_g.within").alias("within"), "doc_id", "set"), percent)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lean = materialize(signatures(docs, k, percent / 100), "signatures")
    with_set = lean.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = materialize(with_set.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes", of=lean)
    reps = with_set.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).select("doc_id", F.explode("keys").alias("key"))
    reps = materialize(reps, "bands", of=lean)
    buckets = materialize(reps.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("key", "least"), "buckets", of=reps)
    stars = join_small(reps, buckets, "key", "inner").filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    candidates = materialize(connected_components(stars), "candidates", of=reps)

    members = join_small(lean.select(F.col("doc_id").alias("node"), "n_shingles").filter("node is not null"), candidates, "node", "inner")
    members = members.groupBy("node", "component").agg(F.max("n_shingles").alias("n"))
    weigh = materialize(members.groupBy("component").agg(F.sum("n").alias("hashes")), "component-sizes", of=candidates)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("hashes") / F.lit(BLOCK_HASHES))).cast("int")
    placed = materialize(join_small(candidates, weigh.select("component", blocks.alias("blocks")), "component", "inner"), "placed", of=candidates)

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch):
                own = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "component", "blocks")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())], ["doc_id", "component", "blocks", "set"])

    of_members = join_small(docs, placed.withColumnRenamed("node", "doc_id"), "doc_id", "inner")
    of_reps = of_members.select("doc_id", "component", "blocks", "text").mapInArrow(tidy(to_sets), "doc_id long, component long, blocks int, set binary").filter(F.length("set") > 0)
    sets = materialize(of_reps, "sets")

    def dealt(rows: DataFrame, seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks"))
        return rows.select(F.concat_ws(":", F.lit(seed), "component", block).alias("task"), F.lit(0).alias("side"), F.lit(True).alias("within"), "doc_id", "set")

    edges = materialize(searched(dealt(sets, 1).unionByName(dealt(sets.filter("blocks > 1"), 2)), percent), "links")
    labels = materialize(connected_components(edges), "labels", of=edges)

    large = sets.filter("blocks > 1").drop("blocks")
    if large.limit(1).count():
        named = join_small(large, labels.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        parts = named.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
        several = parts.groupBy("component").agg(F.max(F.struct("n", "label")).alias("t"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        several = materialize(several.select("component", F.col("t.label").alias("giant")), "unsettled")
        if several.limit(1).count():
            unsettled = materialize(join_small(named, several, "component", "inner"), "unsettled-sets")
            edges = materialize(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links_between(unsettled, percent)), "links")
            labels = materialize(connected_components(edges), "labels", of=edges)

    # a class belongs to its representative's component; most classes are one document that is linked with nothing
    linked = labels.filter("component <> node").select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    final = classes.join(linked, "rep", "left").filter((F.col("n") > 1) | F.col("component_id").isNotNull())
    final = materialize(final.select("digest", F.coalesce("component_id", "rep").alias("component_id")), "final", of=classes)
    out = join_small(lean.select("doc_id", "n_shingles", "digest"), final, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
d AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, list_sort(s) AS s FROM s),
-- equal sets are one class
r AS (SELECT min(doc_id) AS rep, any_value(n) AS n, s FROM d WHERE n > 0 AND doc_id IS NOT NULL GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS h FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n + b.n) AS n, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rep AS node, rep AS root FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node),
o AS (SELECT d.doc_id, d.n, coalesce(m.root, d.doc_id) AS component FROM d LEFT JOIN r ON r.s = d.s AND d.n > 0 LEFT JOIN m ON m.node = r.rep)
SELECT doc_id, n AS n_shingles, component AS component_id, doc_id = component AS kept FROM o
"""

QUERIES = {"op4_neardup": op4_neardup}
ORACLE = {"op4_neardup": OP4_SQL}
