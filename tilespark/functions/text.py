"""Column functions over paths, model output and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def posix_key(path: Column) -> Column:
    """A path with forward slashes only, without doubled ones, a leading ``./`` or a trailing slash."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"^(\./)+", "")
    return F.regexp_replace(p, "(?<=.)/$", "")


def scene_aoi(path: Column) -> Column:
    """The first directory, or the file's stem where there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.regexp_replace(path, r"\.[^.]*$", ""))


def scene_date(path: Column) -> Column:
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?i)(\d{4}-\d{2}-\d{2})\.tiff?$", 1)
    return F.when(found == "", "unknown").otherwise(found)


def model_boxes(text: Column) -> Column:
    """All boxes in a model's answer: four groups of digits, each the decimals of a fraction of the frame (leading zeros count)."""
    whole = F.regexp_extract_all(text, F.lit(r"\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]"), F.lit(0))
    return F.transform(whole, lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"\d+"), F.lit(0)), lambda g: F.concat(F.lit("0."), g).cast("double")))


def words(text: Column) -> Column:
    """Distinct lower-case words without dots and commas around them."""
    cleaned = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(".,"))))
    return F.array_distinct(F.filter(cleaned, lambda w: w != ""))


def lexical_similarity(query: Column, phrase: Column) -> Column:
    """10 if the phrase holds the query, 3 for every equal pair of words, 0.5 for every other pair of which one holds the other."""
    q, p = F.lower(F.trim(query)), F.lower(phrase)
    base = F.when((q != "") & F.contains(p, q), 10.0).otherwise(0.0)
    pair = lambda a, b: F.when(a == b, 3.0).when(F.contains(a, b) | F.contains(b, a), 0.5).otherwise(0.0)
    q_words, p_words = F.filter(F.split(q, r"\s+"), lambda w: w != ""), F.split(p, r"\s+")
    pairs = F.flatten(F.transform(q_words, lambda a: F.transform(p_words, lambda b: pair(a, b))))
    return base + F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def clean_query(text: Column, most: int = 2000) -> tuple[Column, Column]:
    """A trimmed query of ``most`` characters at most, and whether it was cut."""
    t = F.trim(text)
    return F.left(t, F.lit(most)), F.length(t) > most


def signed_score(score: Column) -> Column:
    return F.format_string("%+.4f", score)


def octant(dx: Column, dy: Column) -> Column:
    """Compass direction of a move on the screen, whose y grows downwards."""
    names = F.array(*[F.lit(n) for n in ("east", "southeast", "south", "southwest", "west", "northwest", "north", "northeast")])
    return F.element_at(names, (F.floor(F.pmod(F.degrees(F.atan2(dy, dx)) + 22.5, F.lit(360.0)) / 45) + 1).cast("int"))


def keyword_match(query: str, label: Column) -> Column:
    """Number of the query's words in a label."""
    q = [w for w in {w.strip(".,").lower() for w in query.split()} if w]
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in sorted(q)]), words(label)))


def slug(text: Column) -> Column:
    """Lower-case letters and digits of a text, joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def model_label(model: Column, dim: Column) -> Column:
    """What a model is called where it is offered: ``name · 768-d``; the name alone where the dimension is unknown."""
    return F.when(dim.isNull(), model).otherwise(F.concat(model, F.lit(" \u00b7 "), dim.cast("string"), F.lit("-d")))


def thumbnail_side(asked: Column, least: int = 16, most: int = 512) -> Column:
    """The side of a thumbnail: what was asked for within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), asked))


def number_type(device: Column, major: Column) -> Column:
    """The type a model computes in: half precision on accelerators (``cuda``), by the major number of their capability; whole precision elsewhere."""
    return F.when(device != "cuda", F.lit("float32")).when(major >= 8, F.lit("bfloat16")).when(major < 8, F.lit("float16"))
