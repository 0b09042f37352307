"""Connected components of a graph given by edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.shared import join_small, materialize, remove


class Forest:
    """Union-find over numbers in a task, the smallest member being the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        r = x
        while (p := self.up.get(r, r)) != r:
            r = p
        while (p := self.up.get(x, x)) != r:
            self.up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's edges by stars around the smallest nodes; at most a million nodes are held at a time."""

    def out(f: Forest) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(f.up) if (r := f.root(x)) != x]
        a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], ["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 1_000_000:
            yield out(forest)
            forest = Forest()
    yield out(forest)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, longs); a component is named by its smallest node.

    A node's least neighbour is found with partial aggregation and joined to its edges from a written table, so that adaptive execution can
    split the edges of a node that has very many. Each round is written to the shared folder, which cuts the lineage, in as many files as its edges need.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").mapInArrow(contract, "a long, b long").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")).collect()[0]
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", of=now)
        large = join_small(both.filter("b > a"), least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small star: every node links its smaller neighbours and itself to the least of them
        large = materialize(large.distinct(), "large", of=now)
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least", of=now)
        small = join_small(large, down, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        following = materialize(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges", of=now)
        for old in (now, least, large, down):
            remove(old)
        now = following
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
