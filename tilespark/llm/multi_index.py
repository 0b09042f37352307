"""Approximate nearest neighbours by an inverted multi-index.

Both halves of every unit vector are quantised separately (``k`` centroids each, k-means on a bounded sample), which gives ``k * k``
cells. A query walks the pairs of centroids in order of summed distance with a heap until the cells visited hold ``share`` of all
vectors (at least ``least``), and the entries of those cells are reranked by their exact cosine. Unless it is given, ``share`` is measured: on the sample, true
neighbours of some of its rows are found by brute force, and the share is the one within which ``recall`` of them lie. Neighbours are nearer, and so found
earlier, among all rows than in a sample.

Distribution: vectors are dealt to shards of about ``SHARD`` vectors, cells packed into shards in order and a large cell (say, thousands of
copies of one vector) spread over several; only the ``k * k`` cell counts, a fixed number, come to the driver. A query is sent once to each shard
that holds a cell it visits, with the visited cells as bits. Vectors and queries of a shard meet in one sorted stream, vectors
first, so a task holds one shard and one batch of queries whatever the number of queries.

Work: ``share`` of all pairs of queries and vectors: a third to a half where vectors have no structure, a few hundredths where they lie in clusters.

Defined cases: vectors that are null, zero, hold null or non-finite components, have no id, or have another length than most take no
part; a row repeated with the same id counts once; ties go to the smaller id; fewer than ``top`` candidates give fewer
rows; very large and very small components count like any others; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.shared import materialize, partitions

#: Vectors of a shard, about.
SHARD = 1024
#: Rows on which centroids are fitted at most, chosen by hash of their ids.
FIT_ROWS = 20_000
#: Rows of the sample whose neighbours are looked for to measure the share.
ASKED = 256


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vec`` of the rows that take part; ``vec`` is the vector as an array of double."""
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return typed.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def of_like_size(v: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two each, so that their largest component is about 1: cosines stay what they are to the bit, and no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """``k`` centroids; a centroid that loses all its rows is moved to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = _distances(x, c)
        near = d.argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        far = np.argsort(-d[np.arange(len(x)), near])
        for slot, row in zip(np.flatnonzero(n == 0), far, strict=False):
            c[slot] = x[row]
    return c


def visit_order(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of ``d1[i] + d2[j]`` until they hold ``enough`` vectors; cell number ``i * len(d2) + j``."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, wide = d1[a], d2[b], len(d2)
    heap, taken_in_row, cells, held = [(s1[0] + s2[0], 0, 0)], np.full(len(d1), -1), [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        taken_in_row[i] = j
        cell = int(a[i]) * wide + int(b[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        # (i, j) may be followed in its row once the row above is past it, and opens the row below in the same column
        if j + 1 < wide and (i == 0 or taken_in_row[i - 1] > j):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < len(d1) and taken_in_row[i + 1] == j - 1:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return cells


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64)
    return flat.reshape(len(column), -1)


def measured_share(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, recall: float, top: int = 5) -> float:
    """The share of unit vectors ``x`` to visit for ``recall`` of the ``top`` true neighbours of some of them."""
    half = c1.shape[1]
    cell = _distances(x[:, :half], c1).argmin(1) * len(c2) + _distances(x[:, half:], c2).argmin(1)
    counts = np.bincount(cell, minlength=len(c1) * len(c2))
    asked = np.arange(0, len(x), max(1, len(x) // ASKED))
    needed = []
    for part in np.array_split(asked, max(1, len(asked) // 32)):
        near = x[part] @ x.T
        near[np.arange(len(part)), part] = -np.inf
        d1, d2 = _distances(x[part, :half], c1), _distances(x[part, half:], c2)
        for q in range(len(part)):
            order = np.argsort((d1[q][:, None] + d2[q][None, :]).ravel(), kind="stable")
            before = np.empty(len(counts), dtype=np.int64)
            before[order] = np.cumsum(counts[order]) - counts[order]
            best = np.argpartition(-near[q], min(top, len(x) - 1) - 1)[: min(top, len(x) - 1)] if len(x) > 1 else []
            needed.append(before[cell[best]] / len(x))
    needed = np.concatenate(needed) if needed else np.zeros(0)
    return float(np.quantile(needed, recall)) + 1 / len(x) if len(needed) else 1.0


class MultiIndex:
    """A fitted index over a table of vectors; see the module's docstring."""

    def __init__(self, vectors: DataFrame, k: int = 32, share: float | None = None, least: int = 1000, recall: float = 0.93):
        self.spark, self.share, self.least = vectors.sparkSession, share, least
        rows = usable(vectors)
        lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.dim = lengths[0]["n"] if lengths else 0
        rows = rows.filter(F.size("vec") == self.dim)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vec").toPandas()
        self.half = self.dim // 2
        if self.dim:
            x = of_like_size(np.array(sample["vec"].tolist()))
            x /= np.linalg.norm(x, axis=1)[:, None]
            self.c1, self.c2 = k_means(x[:, : self.half], k), k_means(x[:, self.half :], k, seed=2)
            if share is None:
                self.share = measured_share(x, self.c1, self.c2, recall)
        else:
            self.c1 = self.c2 = np.zeros((1, 0))
            self.share = 1.0
        c1, c2, half = self.c1, self.c2, self.half

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = of_like_size(b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                u = v / np.linalg.norm(v, axis=1)[:, None]
                cell = _distances(u[:, :half], c1).argmin(1) * len(c2) + _distances(u[:, half:], c2).argmin(1)
                packed = pa.array([r.tobytes() for r in v], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int32)), packed], ["vec_id", "cell", "vec"])

        self.rows = materialize(rows.mapInArrow(assign, "vec_id long, cell int, vec binary"), "multi-index")
        n_cells = len(c1) * len(c2)
        self.counts = np.zeros(n_cells, dtype=np.int64)
        for r in self.rows.groupBy("cell").count().collect():  # k * k rows at most
            self.counts[r["cell"]] = r["count"]
        # a cell larger than a shard gets shards of its own; smaller ones are packed in order
        self.first, self.spread = np.zeros(n_cells, dtype=np.int64), np.ones(n_cells, dtype=np.int64)
        shard, room = 0, SHARD
        for cell, n in enumerate(self.counts.tolist()):
            if n > room and room < SHARD:
                shard, room = shard + 1, SHARD
            self.first[cell], self.spread[cell] = shard, max(1, -(-n // SHARD))
            if n > room:
                shard, room = shard + int(self.spread[cell]), SHARD
            else:
                room -= n
        self.shards = shard + 1

    def _members(self) -> DataFrame:
        plan = self.spark.createDataFrame(
            [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(self.first, self.spread, strict=True))], "cell int, first long, spread long"
        )  # k * k rows
        shard = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("spread"))
        return self.rows.join(F.broadcast(plan), "cell").select(
            shard.alias("shard"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "cell", "vec", F.lit(None).cast("binary").alias("bits")
        )

    def _probes(self, queries: DataFrame) -> DataFrame:
        """Each query once for every shard that holds a cell it visits; ``bits`` are the visited cells."""
        c1, c2, half, counts, first, spread = self.c1, self.c2, self.half, self.counts, self.first, self.spread
        enough = max(self.least, int(np.ceil(self.share * counts.sum())))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = _matrix(b.column("vec"))
                u = v / np.linalg.norm(v, axis=1)[:, None]
                d1, d2 = _distances(u[:, :half], c1), _distances(u[:, half:], c2)
                raw, ids = b.column("vec").to_pylist(), b.column("vec_id").to_pylist()
                for q in range(b.num_rows):
                    seen = np.zeros(len(counts), dtype=bool)
                    cells = visit_order(d1[q], d2[q], counts, enough)
                    seen[cells] = True
                    to = sorted({s for c in cells for s in range(first[c], first[c] + spread[c])})
                    bits, n = np.packbits(seen).tobytes(), len(to)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int64()), pa.array([1] * n, pa.int32()), pa.array([ids[q]] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([raw[q]] * n, pa.binary()), pa.array([bits] * n, pa.binary())],
                        ["shard", "kind", "id", "cell", "vec", "bits"],
                    )

        return queries.mapInArrow(walk, "shard long, kind int, id long, cell int, vec binary, bits binary")

    def search(self, queries: DataFrame, top: int = 5) -> DataFrame:
        """``query_id, rank, vec_id, score`` for ``queries``, rows of the index's own table (``vec_id``, ``vec`` as packed doubles)."""
        n_cells = len(self.counts)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, dict[int, float]] = {}

            def flush() -> pa.RecordBatch:
                rows = [(q, v, s) for q, found in best.items() for v, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top]]
                best.clear()
                cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

            def meet(probes: pa.RecordBatch, m: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> None:
                v, q_ids = _matrix(probes.column("vec")), probes.column("id").to_numpy()
                bits = np.frombuffer(b"".join(probes.column("bits").to_pylist()), dtype=np.uint8).reshape(len(v), -1)
                seen = np.unpackbits(bits, axis=1, count=n_cells).astype(bool)
                m_norm, v_norm = np.sqrt((m * m).sum(1)), np.sqrt((v * v).sum(1))
                near = (v / v_norm[:, None]) @ (m / m_norm[:, None]).T
                near[~seen[:, cells]] = -np.inf
                near[q_ids[:, None] == ids[None, :]] = -np.inf
                least = np.partition(near, -top, axis=1)[:, -top] if near.shape[1] > top else np.full(len(v), -np.inf)
                for q in range(len(v)):
                    at = np.flatnonzero((near[q] >= least[q] - 1e-9) & (near[q] > -np.inf))
                    # every pair's cosine by the same operations in the same order, so that equal vectors have equal scores
                    exact = (v[q][None, :] * m[at]).sum(1) / (v_norm[q] * m_norm[at])
                    order = np.lexsort((ids[at], -exact))
                    found = best.setdefault(int(q_ids[q]), {})
                    kept = 0
                    for o in order.tolist():
                        i, s = int(ids[at[o]]), float(exact[o])
                        if i not in found or found[i] < s:
                            found[i] = s
                            kept += 1
                        if kept >= top:
                            break
                    if len(found) > 8 * top:
                        best[int(q_ids[q])] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top])

            shard, parts, m, ids, cells = None, [], None, None, None
            for b in batches:
                cuts = np.flatnonzero(np.diff(b.column("shard").to_numpy())) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                    if hi == lo:
                        continue
                    part = b.slice(lo, hi - lo)
                    if (now := part.column("shard")[0].as_py()) != shard:
                        shard, parts, m = now, [], None
                    n_members = int((part.column("kind").to_numpy() == 0).sum())
                    if n_members:
                        parts.append(part.slice(0, n_members))
                    probes = part.slice(n_members)
                    if not probes.num_rows or not parts and m is None:
                        continue
                    if parts:
                        m = np.concatenate([_matrix(p.column("vec")) for p in parts])
                        ids = np.concatenate([p.column("id").to_numpy() for p in parts])
                        cells = np.concatenate([p.column("cell").to_numpy(zero_copy_only=False) for p in parts])
                        _, once = np.unique(np.concatenate([ids[:, None].view(np.float64), m], axis=1).view(np.dtype((np.void, 8 * (m.shape[1] + 1)))).ravel(), return_index=True)
                        m, ids, cells, parts = m[once], ids[once], cells[once].astype(np.int64), []
                    for at in range(0, probes.num_rows, 512):
                        meet(probes.slice(at, 512), m, ids, cells)
                    if len(best) > 50_000:
                        yield flush()
            yield flush()

        stream = self._members().unionByName(self._probes(queries)).repartition(max(partitions(self.spark), min(self.shards, 4096)), "shard").sortWithinPartitions("shard", "kind")
        found = stream.mapInArrow(score, "query_id long, vec_id long, score double")
        unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return unique.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = MultiIndex(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return index.search(index.rows.filter(F.col("vec_id") % 50 == 0))


QUERIES = {"op1_multi_index": op1_multi_index}
ORACLE: dict[str, str] = {}
