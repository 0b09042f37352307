"""A compact copy of the corpus: an uncentred basis, int8 codes, and what that costs in accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.functions.vectors import dequantised, largest, quantised


def gram(corpus: DataFrame) -> DataFrame:
    """``i, j, v``: ``X'X / n`` without centring, from a matrix of fixed size a task and one aggregation."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("embedding").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
                total, n = x.T @ x + (0 if total is None else total), n + len(x)
        if n:
            i, j = np.divmod(np.arange(total.size), len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel()), pa.array(np.full(total.size, n))], ["i", "j", "v", "n"])

    return corpus.select("embedding").mapInArrow(partial, "i int, j int, v double, n long").groupBy("i", "j").agg((F.sum("v") / F.sum("n")).alias("v"))


def second_moment(corpus: DataFrame) -> np.ndarray:
    """:func:`gram` as a matrix: as many numbers as a vector has, squared, whatever the number of vectors."""
    rows = gram(corpus).orderBy("i", "j").collect()
    if not rows:
        raise ValueError("no vectors")
    dim = int(len(rows) ** 0.5)
    return np.array([r["v"] for r in rows]).reshape(dim, dim)


def basis(corpus: DataFrame, dim: int) -> np.ndarray:
    """The ``dim`` leading directions of the second moment, a row each, largest component positive."""
    values, vectors = np.linalg.eigh(second_moment(corpus))
    rows = vectors[:, np.argsort(-values)[:dim]].T
    return rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]


def in_basis(rows: DataFrame, components: np.ndarray) -> DataFrame:
    """Coordinates in the basis, by matrix products; the basis is sent to every task once (its size is that of a vector, squared)."""
    shipped, names = rows.sparkSession.sparkContext.broadcast(np.asarray(components, dtype=np.float64)), rows.columns
    place = names.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(place).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
                y = x @ shipped.value.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([lists if i == place else c for i, c in enumerate(b.columns)], names)

    fields = [T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == "embedding" else f.dataType) for f in rows.schema]
    return rows.mapInArrow(run, T.StructType(fields))


def coded(rows: DataFrame) -> DataFrame:
    """Adds ``codes`` and the one ``scale`` of the whole table (largest component over 127, 1 if all are zero)."""
    peak = rows.agg(F.max(largest(F.col("embedding"))).alias("_peak"))
    scaled = rows.crossJoin(F.broadcast(peak)).withColumn("scale_", F.when(F.col("_peak") > 0, F.col("_peak") / 127.0).otherwise(F.lit(1.0)))
    return scaled.withColumn("codes", quantised(F.col("embedding"), F.col("scale_"))).drop("_peak")


def decoded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding", dequantised(F.col("codes"), F.col("scale_"))).drop("codes", "scale_")


def overlap(full: DataFrame, compact: DataFrame, k: int) -> DataFrame:
    """Share of the ``k`` best hits of each (query, scale) that the compact copy finds too."""
    both = full.select("query_id", "scale", "vec_id").join(compact.select("query_id", "scale", "vec_id"), ["query_id", "scale", "vec_id"], "left_semi")
    n = full.groupBy("query_id", "scale").agg(F.count(F.lit(1)).alias("n"))
    hit = both.groupBy("query_id", "scale").agg(F.count(F.lit(1)).alias("hit"))
    return n.join(hit, ["query_id", "scale"], "left").select("query_id", "scale", F.round(F.coalesce("hit", F.lit(0)) / F.least("n", F.lit(k)), 6).alias("overlap"))


def size_of(vectors: int, dim: int, queries: int, basemap: int) -> int:
    """Bytes of an export: codes, per-tile columns and query codes, in base64, and the base map."""
    raw = vectors * (dim + 1 + 4 + 4 + 16) + queries * dim
    return -(-raw // 3) * 4 + -(-basemap // 3) * 4


def fitting(vectors: int, queries: int, most: int, dims: list[int], maps: list[tuple[int, int]], floor: int) -> tuple[int, int]:
    """The first (dim, map pixels) that fits into ``most`` bytes: every dimension with the maps at or above the floor, largest first; then, at the smallest
    dimension, the maps below it."""
    ordered = sorted(maps, reverse=True)
    for dim in dims:
        for px, size in ordered:
            if px >= floor and size_of(vectors, dim, queries, size) <= most:
                return dim, px
    for px, size in ordered:
        if px < floor and size_of(vectors, dims[-1], queries, size) <= most:
            return dims[-1], px
    raise ValueError("no choice of dimension and base map fits")
