"""Numbers without a single task, packed columns of an export, and windows of rasters as one binary row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.session import shared_path

#: Rows of a scale that share one packed row.
PIECE = 65_536
#: Tiles that begin within so many pixels (or their own side) are cut from the strips together.
NEAR = 256
#: Packed columns and their types, in the order in which they are written; all little-endian.
KINDS = {"codes": "<i1", "src": "<u4", "px_x": "<i4", "px_y": "<i4", "min_lon": "<f4", "min_lat": "<f4", "max_lon": "<f4", "max_lat": "<f4"}


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Rows with their place (from 0) in an order without ties: sorted by ranges and counted by partition; what meets in one place is one count a partition."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = shared_path(spark, "numbered")
    ranged.write.parquet(path)
    placed = spark.read.schema(ranged.schema).parquet(path)
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())  # one row a partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((int(p), before))
        before += sizes[p]
    if not offsets:
        return placed.withColumn(name, F.col("_at")).drop("_at")
    begins = spark.createDataFrame(offsets, "_p long, _begin long")
    return placed.withColumn("_p", part).join(F.broadcast(begins), "_p").withColumn(name, own + F.col("_begin")).drop("_at", "_p", "_begin")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``key, src``: distinct keys, numbered from 0 in the order in which they first occur (``order`` has no ties)."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return numbered(firsts, [F.col("_first")], "src").drop("_first")


def in_scale(tiles: DataFrame, order: str, name: str = "at") -> DataFrame:
    """Tiles with their place (from 0) within their scale, in the order of a column without ties in a scale."""
    placed = numbered(tiles, [F.col("scale"), F.col(order)], "_number")
    begins = placed.groupBy(F.col("scale").alias("_scale")).agg(F.min("_number").alias("_begin"))  # a row a scale
    return placed.join(begins, F.col("scale") == F.col("_scale")).withColumn(name, F.col("_number") - F.col("_begin")).drop("_number", "_scale", "_begin")


def packed_columns(tiles: DataFrame, piece: int = PIECE) -> DataFrame:
    """``scale, piece, n`` and a binary for each of ``KINDS``: element i of one is element i of every other; a scale's pieces follow each other in ``at``.

    Tiles have ``scale, at`` (place within the scale, from 0, without gaps), ``codes`` (tinyint array), ``src`` and the window and box columns. No row holds more
    than ``piece`` tiles, however many a scale has.
    """
    columns = list(KINDS)
    lists = tiles.groupBy("scale", F.floor(F.col("at") / piece).cast("long").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", *columns))).alias("t"))
    kind = tiles.schema["scale"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in columns}
            sizes = []
            for rows in batch["t"]:
                flat = rows.values
                sizes.append(len(flat))
                for c, t in KINDS.items():
                    x = flat.field(c)
                    x = np.asarray((x.flatten() if c == "codes" else x).to_numpy(zero_copy_only=False))
                    low = np.dtype(t)
                    if low.kind in "iu" and len(x) and (x.min() < np.iinfo(low).min or x.max() > np.iinfo(low).max):
                        raise ValueError(f"{c} does not fit {t}")
                    out[c].append(x.astype(low).tobytes())
            yield pa.RecordBatch.from_arrays([batch["scale"], batch["piece"], pa.array(sizes, pa.int64()), *[pa.array(out[c], pa.binary()) for c in columns]], ["scale", "piece", "n", *columns])

    return lists.mapInArrow(pack, f"scale {kind}, piece long, n long, " + ", ".join(f"{c} binary" for c in columns))


def unpacked_columns(packed: DataFrame, piece: int = PIECE) -> DataFrame:
    """The tiles of :func:`packed_columns` again: ``scale, at`` and the columns."""
    kinds = {"codes": "array<tinyint>", "src": "long", "px_x": "int", "px_y": "int", "min_lon": "float", "min_lat": "float", "max_lon": "float", "max_lat": "float"}
    scale = packed.schema["scale"].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                arrays = {c: np.frombuffer(row[c], t) for c, t in KINDS.items()}
                dim = len(arrays["codes"]) // n if n else 0
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim) if dim else np.zeros(n + 1), pa.int32()), pa.array(arrays.pop("codes"), pa.int8()))
                scales = pa.array([row["scale"]] * n, batch.schema.field("scale").type)
                at = pa.array(row["piece"] * piece + np.arange(n), pa.int64())
                yield pa.RecordBatch.from_arrays([scales, at, codes, *[pa.array(v.astype(np.int64) if c == "src" else v) for c, v in arrays.items()]], ["scale", "at", "codes", *arrays])

    return packed.mapInArrow(unpack, f"scale {scale}, at long, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def tile_bytes(strips: DataFrame, tiles: DataFrame) -> DataFrame:
    """``tile_id, data``: the pixels of every tile as one binary, zeros where it reaches over the raster's right or lower edge.

    Strips are rows of pixels (``raster_id, y, pixel_bytes, data``), tiles are squares (``tile_id, raster_id, scale, px_x, px_y``). Tiles that begin near each other in one row
    of tiles ask together: where strips of their raster lie, a range of bytes is taken from each for all of them, so no row is ever a pixel. A tile without any strip is zeros.
    """
    long = lambda c: F.col(c).cast("long")
    near = F.floor(long("px_x") / F.greatest(long("scale"), F.lit(NEAR)))
    asked = tiles.groupBy("raster_id", "scale", "px_y", near.alias("_near")).agg(F.min("px_x").alias("_left"), F.max(long("px_x") + F.col("scale")).alias("_right"), F.collect_list(F.struct("tile_id", "px_x")).alias("_tiles"))
    depth = strips.groupBy("raster_id").agg(F.max("pixel_bytes").alias("_bytes"))
    asked = asked.join(depth, "raster_id", "left").withColumn("_bytes", F.coalesce("_bytes", F.lit(1)))
    own, other = strips.withColumnRenamed("raster_id", "_raster"), asked.hint("shuffle_hash")  # strips are not sorted; what asks is small beside them
    on = (F.col("_raster") == F.col("raster_id")) & (F.col("y") >= F.col("px_y")) & (F.col("y") < long("px_y") + F.col("scale"))
    part = F.substring("data", (F.col("_left") * F.col("pixel_bytes") + 1).cast("int"), ((F.col("_right") - F.col("_left")) * F.col("pixel_bytes")).cast("int"))
    met = own.join(other, on, "right").select("raster_id", "scale", "px_y", "_near", "_left", "_bytes", "_tiles", F.when(F.col("y").isNotNull(), F.struct(F.col("y").cast("int").alias("y"), "pixel_bytes", part.alias("part"))).alias("_row"))
    # a row of tiles has at most ``scale`` strips
    rows = met.groupBy("raster_id", "scale", "px_y", "_near").agg(F.first("_left").alias("_left"), F.first("_bytes").alias("_bytes"), F.first("_tiles").alias("_tiles"), F.sort_array(F.collect_list("_row")).alias("_rows"))
    each = rows.withColumn("_tile", F.explode("_tiles")).withColumns({"_width": (F.col("scale") * F.col("_bytes")).cast("int"), "_n": F.size("_rows")})
    cut = lambda r: F.substring(r["part"], ((F.col("_tile.px_x") - F.col("_left")) * r["pixel_bytes"] + 1).cast("int"), (F.col("scale") * r["pixel_bytes"]).cast("int"))
    padded = lambda data: F.rpad(F.hex(data), 2 * F.col("_width"), F.lit("0"))
    whole = lambda lines: F.unhex(F.rpad(F.array_join(lines, ""), (2 * F.col("_width") * F.col("scale")).cast("int"), F.lit("0")))
    ys = F.transform("_rows", lambda r: r["y"])
    follow = (F.size(F.array_distinct(ys)) == F.col("_n")) & ((F.col("_n") == 0) | (F.element_at(ys, -1) == F.col("px_y") + F.col("_n") - 1))
    by_y = F.map_from_entries(F.transform("_rows", lambda r: F.struct(r["y"], cut(r))))  # some are missing; one that is there twice ends the query
    line = lambda y: F.coalesce(F.element_at(by_y, y.cast("int")), F.lit(b""))
    plain, gaps = F.transform("_rows", lambda r: padded(cut(r))), F.transform(F.sequence(F.col("px_y"), F.col("px_y") + F.col("scale") - 1), lambda y: padded(line(y)))
    return each.select(F.col("_tile.tile_id").alias("tile_id"), F.when(follow, whole(plain)).otherwise(whole(gaps)).alias("data"))


def opening_phrases(areas: DataFrame, phrases: DataFrame, chosen: DataFrame, fallback: str) -> DataFrame:
    """``aoi, phrase, at``: the phrase each area opens with, ``chosen`` (``aoi, phrase``) for it or the fallback, and its place among ``phrases`` (``at, phrase``).

    A phrase that is not offered ends the query: a page would open with nothing. Repeated areas are one, as are repeated phrases (the first place counts).
    """
    first = phrases.groupBy("phrase").agg(F.min("at").alias("at"))
    opens = areas.select("aoi").distinct().join(chosen.groupBy("aoi").agg(F.min("phrase").alias("phrase")), "aoi", "left").withColumn("phrase", F.coalesce("phrase", F.lit(fallback)))
    absent = F.raise_error(F.concat(F.lit("not among the phrases: "), F.col("phrase")))
    return opens.join(first, "phrase", "left").select("aoi", "phrase", F.when(F.col("at").isNull(), absent.cast("int")).otherwise(F.col("at").cast("int")).alias("at"))
