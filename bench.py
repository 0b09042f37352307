"""Times the headline queries and prints one line of JSON. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.

Beside them it times searches of a corpus of 104,374 vectors of 768 numbers at three scales (ten best each): one query and a batch of 226, packed and cached once, 20
repetitions after warm-up; and an empty job of the same kind, which is what Spark itself costs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tilespark.operators import ranking  # noqa: E402
from tilespark.plans import exports, layout, search, tracking  # noqa: E402
from tilespark.session import session  # noqa: E402

HEADLINE = {
    search: ["topk_per_scale", "topk_by_matrix", "topk_bbox", "scale_stats", "confidence_band", "model_compare"],
    layout: ["tile_plan", "tile_counts", "overlap_tile_origins", "content_duplicates"],
    tracking: ["detection_prf", "clear_mot", "idf1", "grounding_recall", "trajectory_phases"],
    exports: ["topk_overlap", "gram_matrix", "int8_roundtrip"],
}
VECTORS, DIM, BATCH, TIMES = 104_374, 768, 226, 20


def repeated(run: Callable[[], object], times: int) -> list[float]:
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return took


def unit_vectors(spark: SparkSession, n: int, cpus: int):
    def make(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            x = np.stack([np.random.default_rng(int(i)).standard_normal(DIM, dtype=np.float32) for i in ids])
            x /= np.linalg.norm(x, axis=1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array((448 // 2 ** (ids % 3)).astype(np.int32)), lists], ["vec_id", "scale", "embedding"])

    return spark.range(0, n, 1, cpus).mapInArrow(make, "vec_id long, scale int, embedding array<float>")


def wide_search(spark: SparkSession, cpus: int) -> dict[str, float]:
    blocks = ranking.packed(unit_vectors(spark, VECTORS, cpus)).cache()
    blocks.count()
    asked = unit_vectors(spark, BATCH, 1).selectExpr("vec_id query_id", "embedding").collect()
    rows = [spark.createDataFrame(x, "query_id long, embedding array<float>").cache() for x in (asked[:1], asked)]
    found: dict[str, float] = {}
    for name, queries in zip(("one", f"batch_{BATCH}"), rows, strict=True):
        queries.count()
        took = repeated(lambda q=queries: ranking.top_packed(blocks, q, 10).collect(), TIMES + 3)[3:]
        found |= {f"wide_{name}_median": statistics.median(took), f"wide_{name}_max": max(took)}
    empty = repeated(lambda: spark.range(0, 8, 1, cpus).mapInArrow(lambda bs: bs, "id long").groupBy("id").count().collect(), TIMES + 3)[3:]
    blocks.unpersist()
    return {k: round(v, 4) for k, v in (found | {"wide_empty_job_median": statistics.median(empty)}).items()}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for module, names in HEADLINE.items():
        for name in names:  # the first run compiles, the second counts
            took[name] = round(repeated(lambda m=module, n=name: m.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save(), 2)[1], 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took | wide_search(spark, int(cpus)), "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
