"""A search engine over indexed areas and models: cached corpora, checked arguments, answers and comparisons.

Text becomes a vector outside: an :class:`Embedder` is given by the caller. :class:`HashedWords` is a stand-in for demonstrations, not a model.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.geometry import intersects
from tilespark.functions.text import signed_score
from tilespark.operators import ranking

MOST_RESULTS, MOST_CHARS, ANY_DATE = 200, 2000, ("", "any", None)


class BadRequest(ValueError):
    """Arguments that no answer exists for."""


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, text: str) -> list[float]: ...


class HashedWords:
    """Stand-in: hashed bag of words, of unit length."""

    def __init__(self, dim: int, model_id: str = "hashed-words"):
        self.dim, self.model_id = dim, model_id

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for w in text.lower().split() or [""]:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else [1.0] + [0.0] * (self.dim - 1)


def checked_query(vector: list[float]) -> list[float]:
    """A query vector of unit length within 1e-5, or an error: never repaired."""
    n = math.sqrt(sum(x * x for x in vector))
    if not math.isfinite(n) or abs(n - 1.0) > 1e-5:
        raise BadRequest(f"query vector has length {n}")
    return vector


def clamped(top_k: int) -> int:
    return max(1, min(MOST_RESULTS, top_k))


def cleaned(text: str) -> tuple[str, bool]:
    """The trimmed text, cut to 2000 characters, and whether it was cut; an empty one is an error."""
    t = text.strip()
    if not t:
        raise BadRequest("type a description of what to look for")
    return t[:MOST_CHARS], len(t) > MOST_CHARS


def checked_box(bbox) -> tuple[float, float, float, float] | None:
    if bbox is None:
        return None
    if len(bbox) != 4 or not all(math.isfinite(float(x)) for x in bbox):
        raise BadRequest("a box has four finite numbers")
    return tuple(float(x) for x in bbox)


@dataclass
class Engine:
    """``corpora`` by model: vec_id, scale, aoi, acq_date, embedding and the tile's box; ``backgrounds`` by model: aoi, scale, top1."""

    spark: SparkSession
    corpora: dict[str, DataFrame]
    embedders: dict[str, Embedder]
    backgrounds: dict[str, DataFrame] = field(default_factory=dict)
    _cached: dict[str, DataFrame] = field(default_factory=dict)

    def corpus(self, model_id: str, aoi: str = "all") -> DataFrame:
        """A model's vectors, kept in memory once read; an area that is not indexed is an error."""
        if model_id not in self.corpora:
            raise BadRequest(f"no index of {model_id}")
        rows = self._cached.setdefault(model_id, self.corpora[model_id].cache())
        if aoi == "all":
            return rows
        if not rows.filter(F.col("aoi") == aoi).limit(1).count():
            raise BadRequest(f"{aoi} is not indexed")
        return rows.filter(F.col("aoi") == aoi)

    def dates(self, model_id: str, aoi: str = "all") -> list[str]:
        rows = self.corpus(model_id, aoi).filter("acq_date <> 'unknown'").select("acq_date").distinct()
        return sorted(r[0] for r in rows.collect())  # one row a date

    def rank(self, model_id: str, vector: list[float], aoi: str = "all", bbox=None, date: str | None = None, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Hits and a summary per scale. A date narrows the corpus first; a box only narrows the hits, so confidence is over all of the scale."""
        rows, q = self.corpus(model_id, aoi), checked_box(bbox)
        if date not in ANY_DATE:
            rows = rows.filter(F.col("acq_date") == date)
        asked = self.spark.createDataFrame([(0, checked_query(vector))], "query_id int, embedding array<double>")
        inside = rows if q is None else rows.filter(intersects(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"), q))
        hits = ranking.top(ranking.scored(inside, asked, ["scale", "vec_id"]), clamped(top_k), ["query_id", "scale"])
        summary = ranking.scale_summary(ranking.scored(rows, asked, ["scale", "vec_id"]))
        background = self.backgrounds.get(model_id)
        if background is None:
            background = self.spark.createDataFrame([], "aoi string, scale int, top1 double")
        elif aoi != "all":
            background = background.filter(F.col("aoi") == aoi)
        rated = ranking.confidence(summary.select("query_id", "scale", "top1"), background.select("scale", "top1"))
        shown = hits.join(rows.select("vec_id", "aoi", "acq_date", "min_lon", "min_lat", "max_lon", "max_lat"), "vec_id")
        shown = shown.select("scale", "rank", "vec_id", "score", signed_score(F.col("score")).alias("shown"), "aoi", "acq_date", ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"))
        return shown, summary.join(rated.drop("top1"), ["query_id", "scale"]).drop("query_id")

    def answer(self, text: str, model_id: str, **where) -> dict:
        t, cut = cleaned(text)
        hits, summary = self.rank(model_id, self.embedders[model_id].embed(t), **where)
        return {"query": t, "truncated": cut, "model_id": model_id, "hits": hits, "scales": summary}

    def compare(self, text: str, models: list[str], **where) -> list[dict]:
        """The models' answers side by side, never merged; a model without an index is reported as not available."""
        t, _ = cleaned(text)
        return [{"model_id": m, "available": True} | self.answer(t, m, **where) if m in self.corpora and m in self.embedders else {"model_id": m, "available": False} for m in models]
