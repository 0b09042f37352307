"""Detections from overlapping tiles of a frame, reconciled frame by frame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tilespark.functions.geometry import area, box, covered, seams, to_frame
from tilespark.operators.matching import Detections, survivors

FIELDS = ["x1", "y1", "x2", "y2"]


def in_frame(detections: DataFrame, tiles: DataFrame, margin: float = 2.0) -> DataFrame:
    """Tile-local boxes moved into the frame, empty ones dropped, with flags for sides cut by an interior tile edge.

    ``detections``: frame_id, tile, x1..y2, score and whatever else is known of them, which rides along; ``tiles``: frame_id, tile, x0, y0, x1, y1, width, height.
    """
    more = [c for c in detections.columns if c not in ("frame_id", "tile", "score", *FIELDS)]
    t = tiles.select("frame_id", "tile", "width", "height", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    joined = detections.join(t, ["frame_id", "tile"]).withColumn("b", to_frame(box(*FIELDS), F.col("t_x0"), F.col("t_y0"), F.col("t_x1") - F.col("t_x0"), F.col("t_y1") - F.col("t_y0")))
    flags = seams(F.col("b"), F.col("t_x0"), F.col("t_y0"), F.col("t_x1"), F.col("t_y1"), F.col("width"), F.col("height"), margin)
    kept = joined.filter((F.col("b.x2") > F.col("b.x1")) & (F.col("b.y2") > F.col("b.y1")))
    return kept.select("frame_id", "tile", *[F.col(f"b.{c}").alias(c) for c in FIELDS], "score", flags.alias("seams"), *more)


def detected(tiles: DataFrame, find: Callable[[dict], Iterable[dict]], fields: str = "x1 double, y1 double, x2 double, y2 double, score double") -> DataFrame:
    """What a caller's detector finds in every tile: ``frame_id, tile`` and ``fields``. ``find`` takes a tile's row (its pixels, its prompt) and names tile-local
    boxes; it is called a batch of tiles at a time in the tasks that hold them, and loads its model when it is first called."""
    schema = T.StructType([tiles.schema["frame_id"], tiles.schema["tile"], *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"frame_id": t["frame_id"], "tile": t["tile"], **hit} for t in b.to_pylist() for hit in find(t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    return tiles.mapInArrow(run, schema)


def seam_duplicates(found: DataFrame, contained: float = 0.6) -> DataFrame:
    """Cut boxes that a larger box of another tile of the frame covers: what :func:`reconciled` drops before the last step."""
    cut = found.filter(F.exists("seams", lambda s: s)).alias("d")
    other = found.alias("o")
    d, o = box(*[f"d.{c}" for c in FIELDS]), box(*[f"o.{c}" for c in FIELDS])
    on = (F.col("d.frame_id") == F.col("o.frame_id")) & (F.col("d.tile") != F.col("o.tile")) & (area(o) > area(d)) & (covered(d, o) >= contained)
    return cut.join(other, on, "left_semi")


def _per_frame(found: DataFrame, settle: Callable[[Detections], Detections]) -> DataFrame:
    """``frame_id, x1..y2, score`` and extra columns of what is left of each frame's detections, in the order of tile, place and score (highest first).

    A frame's detections travel as one array; a batch of frames is sorted and written at once, so that only ``settle`` is called once a frame.
    """
    more = [c for c in found.columns if c not in ("frame_id", "tile", "score", "seams", *FIELDS)]
    schema = T.StructType([found.schema[c] for c in ("frame_id", *FIELDS, "score", *more)])
    own = F.struct("tile", *FIELDS, "score", "seams", F.struct(*[F.col(f"`{c}`") for c in more] or [F.lit(None).alias("nothing")]).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(schema)
        for b in batches:
            lists = b.column("found")
            flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            rows = pa.table([pa.array(owner), *[flat.field(c) for c in ("tile", *FIELDS, "score")]], names=["owner", "tile", *FIELDS, "score"])
            order = pc.sort_indices(rows, sort_keys=[*((c, "ascending") for c in ("owner", "tile", *FIELDS)), ("score", "descending")])
            rows, flat = rows.take(order), flat.take(order)
            boxes = np.stack([rows[c].to_numpy().astype(float) for c in FIELDS], axis=1)
            scores, seen = rows["score"].to_numpy().astype(float), flat.field("seams").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            tiles = np.unique(rows["tile"].to_numpy(), return_inverse=True)[1]
            ends = np.searchsorted(owner, np.arange(len(lists) + 1))  # owners ascend, before sorting and after
            left = [settle(Detections(boxes[i:j], scores[i:j], tiles[i:j], seen[i:j], np.arange(i, j))) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            source = np.concatenate([d.source for d in left]) if left else np.zeros(0, dtype=np.int64)
            columns = [b.column("frame_id").take(pa.array(owner[source])), *np.concatenate([d.boxes for d in left]).T, np.concatenate([d.scores for d in left])] if left else [pa.array([])] * 6
            rest = flat.field("more").take(pa.array(source))
            columns += [rest.field(i) for i in range(len(more))]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)

    return found.groupBy("frame_id").agg(F.collect_list(own).alias("found")).mapInArrow(run, schema)


def suppressed(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression of duplicates per frame."""

    return _per_frame(found, lambda d: d.take(survivors(d.boxes, d.scores, threshold)))


def stitched(found: DataFrame, margin: float = 2.0) -> DataFrame:
    return _per_frame(found, lambda d: d.stitched(margin))


def reconciled(found: DataFrame, margin: float = 2.0, contained: float = 0.6, threshold: float = 0.5, stitch: bool = True) -> DataFrame:
    """Fragments stitched, boxes that a neighbour saw whole dropped, duplicates suppressed."""

    def settle(d: Detections) -> Detections:
        d = (d.stitched(margin) if stitch else d).without_seam_duplicates(contained)
        return d.take(survivors(d.boxes, d.scores, threshold))

    return _per_frame(found, settle)
