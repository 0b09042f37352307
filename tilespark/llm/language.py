"""Language identification with a string kernel.

The kernel is the blended spectrum of n-gram presence: two texts are as alike as the number of distinct character n-grams (1 to 3) that both
hold, over the root of the product of their numbers. ``landmarks`` texts, chosen in equal numbers per language, give a Nyström map (kernel to the landmarks
times the inverse root of the kernel among them), and one ridge regression per language is fitted on it (one versus rest).

Scoring a batch is a product of two matrices: presence of n-grams in the batch's texts by presence of n-grams in the landmarks, then by the
coefficients. N-grams are those of the landmarks, a bounded number; whole texts are read. Every letter of the landmarks has a code of its own, in any script.
Scripts with many letters have too many n-grams for matrices: then n-grams are looked up by bisection and matches are counted by lists of the landmarks that hold each.

Fitting takes ``per_language`` learning rows of every language at most, those with the smallest hash of id and text, and of these as many as keep within
the language's share of ``characters``: a bounded sample, however many rows share an id or have none. Everything else (the languages, the rows scored) covers all rows.

Defined cases: null text, and text without letters, is ``und`` with score 0; rows without lang are not learnt from; null ids are learnt from (their remainder is
that of the empty string) and scored; without any learning rows every text is ``und``; repeated rows are scored each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.shared import bounded_batches, join_small, materialize

#: Numbers of n-grams that a dense table can hold (more are sorted), and columns that a dense matrix can have (more are listed).
TABLE, COLUMNS = 4_000_000, 65_536


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _codes(text: str, table: np.ndarray) -> np.ndarray:
    """Small codes of the lower-cased characters, runs of anything but letters being one space (code 0)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = table[points]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return np.concatenate([[0], c[keep], [0]])


def _grams(codes: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the 1-, 2- and 3-grams at every place, of ``wide`` codes; an n-gram's number tells its length too."""
    c = codes.astype(np.int64)
    two = c[:-1] * wide + c[1:]
    return c, wide + two, wide + wide * wide + two[:-1] * wide + c[2:]


class StringKernel:
    """Fitted coefficients; small enough to travel with a task."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = 160, ridge: float = 1e-3):
        self.languages = sorted(set(languages))
        by = {x: [t for t, y in zip(texts, languages, strict=True) if y == x] for x in self.languages}
        each = max(1, landmarks // max(1, len(by)))
        marks = [t for x in self.languages for t in by[x][:each]]
        points = np.unique(np.frombuffer("".join(t.lower() for t in marks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        letters = [p for p in points.tolist() if chr(p).isalpha()]
        # code 0: not a letter; 1: a letter that no landmark has
        self.table = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        self.table[[p for p in range(len(self.table)) if chr(p).isalpha()]] = 1
        self.table[letters] = 2 + np.arange(len(letters))
        self.wide = len(letters) + 2
        self.seen = np.unique(np.concatenate([np.unique(np.concatenate(_grams(_codes(t, self.table), self.wide))) for t in marks]))
        self.column = None
        size = self.wide**3 + self.wide**2 + self.wide
        if size <= TABLE:
            self.column = np.full(size, -1, dtype=np.int32)
            self.column[self.seen] = np.arange(len(self.seen))
        self.width = len(self.seen)
        self.n_marks, self.listed = len(marks), self.width > COLUMNS
        if self.listed:
            held = [self._held(t) for t in marks]
            self.mark_norm = np.sqrt(np.maximum([len(h) for h in held], 1)).astype(np.float32)
            at = np.concatenate(held)
            self.holders = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])[np.argsort(at, kind="stable")]
            self.ends = np.cumsum(np.bincount(at, minlength=self.width))
        else:
            self.marks = self._presence(marks)
            self.mark_norm = np.sqrt(np.maximum(self.marks.sum(1), 1))
        k_mm = self._kernel(marks)
        values, vectors = np.linalg.eigh(k_mm.astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        x = np.concatenate([self._kernel(texts[i : i + 256]) for i in range(0, len(texts), 256)]).astype(np.float64) @ root
        x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        y = np.array([[1.0 if a == b else -1.0 for b in self.languages] for a in languages])
        w = np.linalg.solve(x1.T @ x1 + ridge * len(x) * np.eye(x1.shape[1]), x1.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def _columns(self, text: str) -> Iterator[np.ndarray]:
        """Columns of the n-grams of a text that landmarks have, with repeats."""
        codes = _codes(text, self.table)
        for lo in range(0, max(1, len(codes) - 2), 1 << 20):  # long texts in pieces that overlap by two characters
            for g in _grams(codes[lo : lo + (1 << 20) + 2], self.wide):
                if self.column is not None:
                    at = self.column[g]
                    yield at[at >= 0]
                else:
                    at = np.minimum(np.searchsorted(self.seen, g), self.width - 1)
                    yield at[self.seen[at] == g]

    def _held(self, text: str) -> np.ndarray:
        return np.unique(np.concatenate([np.unique(at) for at in self._columns(text)]))

    def _presence(self, texts: list[str]) -> np.ndarray:
        p = np.zeros((len(texts), self.width), dtype=np.float32)
        for i, t in enumerate(texts):
            for at in self._columns(t):
                p[i, at] = 1
        return p

    def _kernel(self, texts: list[str]) -> np.ndarray:
        if not self.listed:
            presence = self._presence(texts)
            both, n = presence @ self.marks.T, presence.sum(1)
        else:
            both, n = np.zeros((len(texts), self.n_marks), dtype=np.float32), np.zeros(len(texts), dtype=np.float32)
            for i, t in enumerate(texts):
                at = self._held(t)
                n[i] = len(at)
                k = self.ends[at] - np.where(at > 0, self.ends[at - 1], 0)
                stops = np.cumsum(k)
                both[i] = np.bincount(self.holders[np.repeat(self.ends[at] - stops, k) + np.arange(k.sum())], minlength=self.n_marks)
        return both / np.sqrt(np.maximum(n, 1))[:, None] / self.mark_norm[None, :]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the best regression's share after a soft maximum."""
        f = self._kernel(texts) @ self.weights + self.bias
        e = np.exp(4.0 * (f - f.max(1, keepdims=True)).astype(np.float64))
        best = f.argmax(1)
        return [self.languages[b] for b in best.tolist()], e[np.arange(len(f)), best] / e.sum(1)


def sample(docs: DataFrame, per_language: int = 800, characters: int = 64_000_000) -> DataFrame:
    """``lang, h, text``: the learning rows of ``docs`` (``doc_id, text, lang``) that are fitted on: ``per_language`` of each language and
    ``characters`` over all languages at most, which bounds what the driver holds; a text longer than its language's share is not learnt from."""
    usable = ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)
    rows = docs.filter(usable).select("lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("h"), F.length("text").alias("size"), "text")
    # rows are chosen by language, hash and length alone; texts only meet the few that are chosen
    lean = rows.select("lang", "h", "size")
    n = materialize(lean.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    share = characters // max(1, n.count())
    # hashes below a level that leaves about twice the rows wanted of each language, so that no language's rows meet in one task
    level = F.lit(2.0 * per_language) / F.col("n") * F.lit(2.0**64) - F.lit(2.0**63)
    few = join_small(lean.filter(F.col("size") <= share), n, "lang", "inner").filter((F.col("n") <= 2 * per_language) | (F.col("h").cast("double") <= level)).select("lang", "h", "size").distinct()
    by_hash = Window.partitionBy("lang").orderBy("h")
    few = few.withColumn("k", F.row_number().over(by_hash)).withColumn("sum", F.sum("size").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = materialize(few.filter((F.col("k") <= per_language) & (F.col("sum") <= share)).select("lang", "h"), "chosen")
    # equal rows are one
    return join_small(rows.select("lang", "h", "text"), chosen, ["lang", "h"], "inner").groupBy("lang", "h").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, per_language: int = 800, characters: int = 64_000_000) -> StringKernel | None:
    """Fit on the :func:`sample` of ``docs``."""
    found = sample(docs, per_language, characters).toPandas().sort_values(["lang", "h"])
    return StringKernel(found["text"].tolist(), found["lang"].tolist()) if len(found) else None


def predict(docs: DataFrame, model: StringKernel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; only the text is looked at."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                has = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                lang, best = ["und"] * len(texts), np.zeros(len(texts))
                if has and shipped.value is not None:
                    names, scores = shipped.value.predict([texts[i] for i in has])
                    for i, x, s in zip(has, names, scores, strict=True):
                        lang[i], best[i] = x, s
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))


QUERIES = {"op10_language": op10_language}
ORACLE: dict[str, str] = {}
