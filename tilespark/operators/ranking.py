"""Exact search over vectors, scale by scale.

Every vector of the corpus is scored against every query; scales and models are never pooled. Two ways of scoring give the same ranks:
``scored`` and ``top`` stay inside generated code and are the plan Catalyst can see through; :func:`top_packed` multiplies matrices over a corpus that is packed once
(:func:`packed`, to be cached or written), for repeated, many or long queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions.vectors import dot

#: Queries of a block: sent to every task at once, or met as one row.
QUERY_BLOCK = 1024
#: Vectors of a packed row at most.
PACK = 4096
#: Single precision is off by less than this for unit vectors: what comes so near to the k-th is scored again in double precision.
MARGIN = 1e-4


def scored(corpus: DataFrame, queries: DataFrame, carry: list[str]) -> DataFrame:
    """``query_id, *carry, score`` of every vector for every query; the score is rounded so that equal vectors rank by id.

    Queries are sent to every task, ``QUERY_BLOCK`` of them at most, which the plan itself checks: more of them raise when it runs, and :func:`top_packed`, which meets them
    by blocks, is the way for those.
    """
    asked = queries.select("query_id", F.col("embedding").alias("_q")).limit(QUERY_BLOCK + 1)
    room = asked.agg(F.count(F.lit(1)).alias("_asked"))
    fits = F.when(F.col("_asked") > QUERY_BLOCK, F.raise_error(F.lit(f"more than {QUERY_BLOCK} queries: use top_packed"))).otherwise(F.lit(True))
    few = asked.crossJoin(F.broadcast(room)).filter(fits.cast("boolean")).drop("_asked")  # one row beside at most a block
    return corpus.crossJoin(F.broadcast(few)).select("query_id", *carry, F.round(dot(F.col("embedding"), F.col("_q")), 6).alias("score"))


def top(rows: DataFrame, k: int, within: list[str], tie: str = "vec_id") -> DataFrame:
    """The ``k`` best of each group, ranked from 1; ties go to the smaller id."""
    order = Window.partitionBy(*within).orderBy(F.desc("score"), tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def _packer(ident: str, group: str | None):
    """Rows in matrices of at most ``PACK`` rows: ``group, ids, matrix, kind`` (a NumPy type), one group each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(g: int) -> pa.RecordBatch:
            parts = held.pop(g)
            ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([m.dtype.str])], ["group", "ids", "matrix", "kind"])

        for b in batches:
            if not b.num_rows:
                continue
            m, ids = _matrix(b.column("embedding")), b.column(ident).to_numpy().astype(np.int64)
            groups = b.column(group).to_numpy() if group else np.zeros(len(ids), dtype=np.int32)
            for g in np.unique(groups).tolist():
                own = groups == g
                held.setdefault(g, []).append((ids[own], m[own]))
                if sum(len(p[0]) for p in held[g]) >= (PACK if group else QUERY_BLOCK):
                    yield out(g)
        for g in list(held):
            yield out(g)

    return run


def packed(corpus: DataFrame) -> DataFrame:
    """A corpus (``vec_id, scale, embedding``) in matrices, a few rows a task: cache or write it, then ask :func:`top_packed` again and again."""
    return corpus.select("vec_id", "scale", "embedding").mapInArrow(_packer("vec_id", "scale"), "group int, ids binary, matrix binary, kind string")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions that may be among the ``k`` best, ties and what single precision may have misplaced included."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - MARGIN)


def _meet(scale: int, ids: np.ndarray, m: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
    """The ``k`` best of a matrix of vectors for every query: ids of the query, scale, ids, scores."""
    rough = q.astype(m.dtype) @ m.T
    for i in range(len(q_ids)):
        near = _best(rough[i], k)
        exact = np.round(m[near].astype(np.float64) @ q[i].astype(np.float64), 6)
        best = np.lexsort((ids[near], -exact))[:k]
        yield np.full(len(best), q_ids[i]), np.full(len(best), scale, np.int32), ids[near[best]], exact[best]


def top_packed(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As :func:`scored` and :func:`top` per (query, scale), by products of packed matrices; each meeting of queries and vectors keeps ``k`` of a query.

    Up to ``QUERY_BLOCK`` queries, which a bounded look settles, are sent to every task. More are packed as well, and blocks of them meet the corpus's blocks row
    by row: neither queries nor hits are ever gathered then.
    """
    asked = queries.select("query_id", "embedding")
    few = asked.limit(QUERY_BLOCK + 1).toArrow().combine_chunks()
    all_of_them = few.num_rows <= QUERY_BLOCK
    shipped = None
    if all_of_them:
        q = _matrix(few.column("embedding").combine_chunks()) if few.num_rows else np.zeros((0, 0))
        shipped = blocks.sparkSession.sparkContext.broadcast((few.column("query_id").to_numpy().astype(np.int64), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate([f[c] for f in found]) if found else [] for c in range(4)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "scale", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                at = lambda c, b=b, r=r: b.column(c)[r]
                ids = np.frombuffer(at("ids").as_buffer(), np.int64)
                m = np.frombuffer(at("matrix").as_buffer(), at("kind").as_py()).reshape(len(ids), -1)
                if shipped is not None:
                    q_ids, q = shipped.value
                else:
                    q_ids = np.frombuffer(at("q_ids").as_buffer(), np.int64)
                    q = np.frombuffer(at("q_matrix").as_buffer(), at("q_kind").as_py()).reshape(len(q_ids), -1)
                if len(q_ids):
                    found += _meet(at("group").as_py(), ids, m, q_ids, q, k)
                if len(found) > 20_000:
                    yield out()
        yield out()

    if not all_of_them:
        packed_queries = asked.mapInArrow(_packer("query_id", None), "group int, ids binary, matrix binary, kind string")
        blocks = blocks.crossJoin(packed_queries.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("kind").alias("q_kind")))
    return top(blocks.mapInArrow(run, "query_id long, scale int, vec_id long, score double"), k, ["query_id", "scale"])


def top_by_matrix(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """:func:`top_packed` of a corpus that is packed on the way."""
    return top_packed(packed(corpus), queries, k)


def scale_summary(rows: DataFrame) -> DataFrame:
    """Size, mean, population deviation and best score of each (query, scale), over all candidates."""
    return rows.groupBy("query_id", "scale").agg(
        F.count(F.lit(1)).alias("corpus_size"), F.round(F.avg("score"), 6).alias("score_mean"), F.round(F.stddev_pop("score"), 6).alias("score_std"), F.max("score").alias("top1")
    )


def confidence(summary: DataFrame, background: DataFrame) -> DataFrame:
    """Share of background scores at or below the best score, in percent, and its band; the background is ``scale, top1``."""
    bg = background.select("scale", F.col("top1").alias("_b"))
    joined = summary.join(bg, "scale", "left").groupBy("query_id", "scale", "top1")
    share = F.avg((F.col("_b") <= F.col("top1")).cast("double")) * 100
    rated = joined.agg(F.round(share, 6).alias("percentile"))
    band = F.when(F.col("percentile").isNull(), "unknown").when(F.col("percentile") < 33, "low").when(F.col("percentile") < 67, "medium").otherwise("high")
    return rated.withColumn("band", band)


def isolation(rows: DataFrame, rank: int = 10, multiple: float = 0.75) -> DataFrame:
    """Whether the best score stands out: its distance to the ``rank``-th in deviations exceeds ``multiple``."""
    # the best of each group are found under a group limit, before anything is shuffled; the rest is aggregated
    ref = top(rows, rank, ["query_id", "scale"]).filter(F.col("rank") == rank).select("query_id", "scale", F.col("score").alias("ref"))
    g = rows.groupBy("query_id", "scale").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top1"), F.stddev_pop("score").alias("std")).join(ref, ["query_id", "scale"], "left")
    gap = F.when((F.col("n") > rank) & (F.col("std") > 0), (F.col("top1") - F.col("ref")) / F.col("std"))
    return g.select("query_id", "scale", F.round(gap, 6).alias("gap"), F.coalesce(gap > multiple, F.lit(False)).alias("weak"))
