"""Writing catalogues, tile plans, tracks, reports and small pages."""

from __future__ import annotations

import base64
import html as markup
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OutsideRoot(ValueError):
    """A target outside the folder that may be written."""


def guarded(path: str, root: str) -> str:
    """``path`` if it lies below ``root`` after resolving dots, else :class:`OutsideRoot`."""
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            if not parts:
                raise OutsideRoot(path)
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    inside = [p for p in root.replace("\\", "/").split("/") if p not in ("", ".")]
    if parts[: len(inside)] != inside or len(parts) == len(inside):
        raise OutsideRoot(path)
    return path


def write_inventory(rasters: DataFrame, path: str, root: str) -> None:
    rasters.select(*sorted(rasters.columns)).write.mode("overwrite").json(guarded(path, root))


def write_tile_plans(tiles: DataFrame, path: str, root: str) -> None:
    tiles.repartition("aoi", "scale").write.mode("overwrite").partitionBy("aoi", "scale").parquet(guarded(path, root))


def write_background(rows: DataFrame, path: str, root: str) -> None:
    rows.write.mode("overwrite").partitionBy("model_id", "aoi").parquet(guarded(path, root))


def write_tracks(boxes: DataFrame, path: str, root: str) -> None:
    """One JSON object per clip and track with its boxes by frame; a track is a bounded row."""
    box = F.struct(F.col("frame").cast("string").alias("key"), F.array("x1", "y1", "x2", "y2").alias("value"))
    rows = boxes.groupBy("clip_id", "track_id").agg(F.map_from_entries(F.array_sort(F.collect_list(box))).alias("boxes"))
    rows.write.mode("overwrite").json(guarded(path, root))


def packed(values: list, kind: str) -> str:
    """Base64 of a typed column, little-endian; ``kind`` is a NumPy type name."""
    import numpy as np

    a = np.asarray(values)
    t = np.dtype(kind).newbyteorder("<")
    if a.size and np.issubdtype(t, np.integer) and (a.min() < np.iinfo(t).min or a.max() > np.iinfo(t).max):
        raise ValueError(f"values do not fit {kind}")
    return base64.b64encode(a.astype(t).tobytes()).decode()


def page(title: str, payload: dict, most: int) -> str:
    """A single page that carries its data; raises when it is larger than ``most`` bytes rather than leave anything out."""
    data = json.dumps(payload, sort_keys=True, separators=(",", ":")).replace("</", "<\\/")
    text = f'<!doctype html><meta charset="utf-8"><title>{markup.escape(title)}</title><script type="application/json" id="data">{data}</script>'
    if (size := len(text.encode())) > most:
        raise ValueError(f"{size} bytes, {most} allowed")
    return text


def data_of(text: str) -> dict:
    """The data block of a page made by :func:`page`."""
    start = text.index(">", text.index('<script type="application/json"')) + 1
    return json.loads(text[start : text.index("</script>", start)])
