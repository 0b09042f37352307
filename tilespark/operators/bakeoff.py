"""Bake-off of candidate models: calibration crops, the best of each query per scale and over all scales, and how its scores spread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries of all candidates together that are sent to every task.
MOST_QUERIES = 1_024


def calibration_crops(spark: SparkSession, size: int, scales: list[int], x: int = 0, y: int = 0) -> DataFrame:
    """``scale, local_x, local_y, scene_x, scene_y``: a square of ``size`` pixels cut without rest at each scale; a scale that does not divide it is refused."""
    for s in scales:
        if s < 1 or size % s:
            raise ValueError(f"scale {s} does not divide {size}")
    rows = spark.createDataFrame([(s,) for s in scales], "scale int")
    side = F.sequence(F.lit(0), (F.lit(size) / F.col("scale") - 1).cast("int"))
    cells = rows.select("scale", F.explode(side).alias("j")).select("scale", "j", F.explode(side).alias("i"))
    local = cells.select("scale", (F.col("i") * F.col("scale")).alias("local_x"), (F.col("j") * F.col("scale")).alias("local_y"))
    return local.select("*", (F.col("local_x") + x).alias("scene_x"), (F.col("local_y") + y).alias("scene_y"))


def bake_off(crops: DataFrame, queries: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """``candidate, query_id, scope, rank, vec_id, score`` (scope: a scale, or 'all') and ``candidate, query_id, n, score_min, score_max, score_mean``.

    Crops are ``candidate, scale, vec_id, embedding``, queries ``candidate, query_id, embedding``; candidates may differ in dimension. One scan over all candidates: every
    batch multiplies its vectors with its candidate's queries and hands on the best ``k`` of each scale and sums; the rest is a ranking of those, per scale and, through
    grouping sets, over all.
    """
    spark = crops.sparkSession
    asked = queries.select("candidate", "query_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("candidate", "query_id").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    of: dict = {}
    for r in asked:
        of.setdefault(r.candidate, []).append(r)
    sent = spark.sparkContext.broadcast({c: ([r.query_id for r in rows], np.array([r.embedding for r in rows])) for c, rows in of.items()})
    q_kind = queries.schema["query_id"].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            candidates, scales, ids = (np.array(batch[c].to_pylist(), dtype=object) for c in ("candidate", "scale", "vec_id"))
            for c, s in {(a, b) for a, b in zip(candidates, scales, strict=True) if a in sent.value}:
                at = np.flatnonzero((candidates == c) & (scales == s))
                names, q = sent.value[c]
                x = np.array(batch["embedding"].take(pa.array(at)).to_pylist(), dtype=np.float64)
                scores = np.array([(x * v).cumsum(axis=1)[:, -1] for v in q])  # summed in order, as the column functions do
                for name, row in zip(names, scores, strict=True):
                    first = np.lexsort((ids[at].astype(np.int64), -np.round(row, 6)))[:k]
                    total = (len(row), float(row.min()), float(row.max()), float(row.sum()))
                    out += [(c, name, int(s), int(ids[at[i]]), float(np.round(row[i], 6)), *(total if n == 0 else (0, None, None, None))) for n, i in enumerate(first)]
            kinds = [batch.schema.field("candidate").type, pa.from_numpy_dtype(np.int64) if q_kind == "bigint" else pa.string() if q_kind == "string" else pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], NAMES)

    NAMES = ["candidate", "query_id", "scale", "vec_id", "score", "n", "least", "most", "total"]
    c_kind = crops.schema["candidate"].dataType.simpleString()
    lean = crops.select("candidate", "scale", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    partial = lean.mapInArrow(best, f"candidate {c_kind}, query_id {q_kind}, scale int, vec_id long, score double, n long, least double, most double, total double")
    scoped = partial.select("candidate", "query_id", F.explode(F.array(F.col("scale").cast("string"), F.lit("all"))).alias("scope"), "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("candidate", "query_id", "scope").orderBy(F.desc("score"), "vec_id"))
    tops = scoped.withColumn("rank", rank).filter(F.col("rank") <= k).select("candidate", "query_id", "scope", "rank", "vec_id", F.round("score", 4).alias("score"))
    mean = F.sum("total") / F.sum("n")
    spread = partial.groupBy("candidate", "query_id").agg(F.sum("n").alias("n"), F.round(F.min("least"), 4).alias("score_min"), F.round(F.max("most"), 4).alias("score_max"), F.round(mean, 4).alias("score_mean"))
    return tops, spread
