"""Raster headers and embeddings through functions the caller brings; nothing here decodes pixels or runs a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "path string, outcome string, error string, width int, height int, band_count int, crs string, px double, distinct_per_band array<int>"


def probed(files: DataFrame, probe: Callable[[str], dict | None]) -> DataFrame:
    """One row per file: opened, not_a_raster (the probe returns None) or unreadable (it raises; recorded, never raised)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [f.split()[0] for f in HEADER.split(", ")]
        for rows in batches:
            out = []
            for path in rows["path"]:
                try:
                    got = probe(path)
                    out.append({"path": path, "outcome": "not_a_raster"} if got is None else {"path": path, "outcome": "opened", **got})
                except Exception as e:
                    out.append({"path": path, "outcome": "unreadable", "error": f"{type(e).__name__}: {e}"[:500]})
            frame = pd.DataFrame({c: pd.Series([o.get(c) for o in out], dtype=object) for c in fields})
            yield frame.astype({"width": "Int32", "height": "Int32", "band_count": "Int32", "px": "float64"})

    return files.select("path").mapInPandas(run, HEADER)


def embedded(tiles: DataFrame, pixels: str, embed: Callable[[list], np.ndarray], dim: int, batch: int = 32) -> DataFrame:
    """``tile_id, embedding`` from a caller's model, ``batch`` tiles at a time, normalised in single precision; wrong shapes and bad numbers raise.

    Tiles that are nodata all over are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                v = np.asarray(embed(part[pixels].tolist()), dtype=np.float32)
                if v.shape != (len(part), dim):
                    raise ValueError(f"the model gave {v.shape}, not {(len(part), dim)}")
                n = np.linalg.norm(v, axis=1, keepdims=True)
                if not np.isfinite(v).all() or (n == 0).any():
                    raise ValueError("the model gave vectors that are not finite or zero")
                yield pd.DataFrame({"tile_id": part["tile_id"].to_numpy(), "embedding": list(v / n)})

    return tiles.filter(F.col("nodata_fraction") < 1.0).select("tile_id", pixels).mapInPandas(run, "tile_id string, embedding array<float>")


def padded_windows(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels of every tile, zeros where the tile reaches over the raster's edge: tile_id, x, y, value."""
    cells = tiles.select("tile_id", "scene_id", "scale", "px_x", "px_y", F.explode(F.sequence(F.lit(0), F.col("scale") - 1)).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.col("scale") - 1)).alias("y"))
    at = cells.withColumn("gx", F.col("px_x") + F.col("x")).withColumn("gy", F.col("px_y") + F.col("y"))
    source = pixels.select("scene_id", F.col("x").alias("gx"), F.col("y").alias("gy"), "value")
    return at.join(source, ["scene_id", "gx", "gy"], "left").select("tile_id", "x", "y", F.coalesce("value", F.lit(0)).alias("value"))
