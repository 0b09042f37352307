"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. They overlap and contradict each other: each looks at one thing (symbols, capitals, marks,
repetition, variety, abusive words) and votes good where that one thing is in order; two more are taught by the ``labels`` table: words that toxic
documents hold far more often than others, and how likely the text's trigrams of character classes are in documents of low quality and in others. The
last labeller is the ``labels`` table itself, where it has the document.

Expectation-maximisation over all documents estimates, without knowing the truth, how often each labeller gives each vote to clean, noisy, repeated and toxic
documents (:class:`LabelModel`). It needs only how often each combination of votes occurs, which one aggregation over all rows counts; combinations are few
whatever the number of rows. The last three are bad; they are classes of their own because one labeller praises what another condemns: a toxic text looks well made to
every labeller that judges form, and so does a repeated phrase to those that count symbols.

The posterior of a document's votes is its soft label, and a linear scorer over hashed words and bucketed statistics is trained on a bounded
sample of them (about ``FIT_ROWS`` documents, twice that at most, and ``FIT_CHARACTERS`` characters, half of them likely bad, chosen and ordered by a hash of
id and text, so that scores do not depend on how rows are partitioned). The scorer decides: documents that score ``REJECT`` or more are rejected. What is taught comes from a
bounded sample of labelled rows too (``LESSON_ROWS`` of each kind, ``LESSON_CHARACTERS`` over all).

Defined cases: null text is empty; a text without words has no votes and scores by its statistics alone, and is kept unless a label teaches otherwise; missing
labels and null labels are no vote; several labels of one document count as the worst; null ids have no label; repeated rows are scored each and learnt from once; an empty table gives an
empty result (nothing is trained); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.shared import bounded_batches, join_small, materialize, tidy, with_fields
from tilespark.llm.shingles import word_hashes

#: Documents the scorer is trained on, about; hashed word features; score from which a document is rejected.
FIT_ROWS, WIDTH, REJECT = 16_000, 1 << 17, 0.5
#: Characters of all texts the scorer is trained on, at most; labelled rows of each kind that teach, and their characters over all kinds.
FIT_CHARACTERS, LESSON_ROWS, LESSON_CHARACTERS = 128_000_000, 8_000, 192_000_000
#: Words taught at most, the log-likelihood ratio one must reach, and how many times more often toxic documents must hold it.
TAUGHT, EVIDENCE, TIMES = 4_096, 25.0, 10.0
GOOD, BAD = 1, 2

# Abusive words and frequent function words of the languages served.
ABUSE = (
    "idiot idiots moron morons imbecile stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns jerk fool fools "
    "vermin filth bastard dumm trottel abschaum dreckig idioten crétin imbécile connard stupide estúpido imbécil idiota basura asqueroso"
).split()
FUNCTION_WORDS = (
    "the of and to in is that it was for on are as with be this at by from or der die das und ist von den mit zu auf für sich des ein eine "
    "le la les et de du des un une est que dans pour pas sur qui avec el los las y del se con por una no su para es al como"
).split()

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_SYMBOLS = np.array([c in b"#*%&$@^~=<>\\_{}[]+" for c in range(256)])
STATISTICS = ("symbols", "capitals", "exclamations", "bars", "neighbours", "variety", "abuse", "function", "length", "words", "digits", "lines", "taught", "profile")
#: Buckets of a statistic.
BUCKETS = 16


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(word_hashes([w.encode().translate(_SPLIT) for w in words])[0])


_ABUSE, _FUNCTION = _hashes(ABUSE), _hashes(FUNCTION_WORDS)


# classes of bytes: space, line, small, capital, digit, stop, symbol, beyond ASCII
_CLASS = np.array([7 if b >= 128 else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 1 if b == 10 else 0 if b in b" \t\r" else 5 if b in b".,;:!?'\"-()" else 6 for b in range(256)], dtype=np.int64)
TRIGRAMS = 8**3


def _trigrams(raw: bytes) -> np.ndarray:
    """How often each trigram of byte classes occurs."""
    counts = np.zeros(TRIGRAMS, dtype=np.int64)
    for lo in range(0, len(raw) - 2, 1 << 20):  # long texts in pieces that overlap by two bytes
        c = _CLASS[np.frombuffer(raw[lo : lo + (1 << 20) + 2], dtype=np.uint8)]
        counts += np.bincount(c[:-2] * 64 + c[1:-1] * 8 + c[2:], minlength=TRIGRAMS)
    return counts


class Lessons:
    """What the labelled sample teaches: hashes of words of toxic documents, and log odds (low against others) of each trigram."""

    def __init__(self, words: np.ndarray | None = None, odds: np.ndarray | None = None):
        self.words = np.unique(np.asarray(words if words is not None else [], dtype=np.uint64))
        self.odds = odds


def measure(texts: list[str | None], lessons: Lessons) -> tuple[np.ndarray, list[np.ndarray]]:
    """A row of ``STATISTICS`` and the distinct word hashes of each text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    h, owner = word_hashes([r.translate(_SPLIT) for r in raws])
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    abusive, function, taught = np.isin(h, _ABUSE), np.isin(h, _FUNCTION), np.isin(h, lessons.words)
    stats, words = np.zeros((len(texts), len(STATISTICS))), []
    for i, raw in enumerate(raws):
        own = h[cuts[i] : cuts[i + 1]]
        distinct = np.unique(own)
        words.append(distinct)
        n = len(own)
        if not n:
            continue
        c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        capitals, small = c[65:91].sum(), c[97:123].sum()
        stats[i] = (
            c[_SYMBOLS].sum() / n,
            capitals / max(1, capitals + small),
            c[33] / n,
            c[124] / n,
            (own[1:] == own[:-1]).mean() if n > 1 else 0.0,
            len(distinct) / n,
            abusive[cuts[i] : cuts[i + 1]].sum(),
            function[cuts[i] : cuts[i + 1]].mean(),
            len(raw) / n,
            n,
            c[48:58].sum() / n,
            c[10] / n,
            taught[cuts[i] : cuts[i + 1]].sum(),
            (_trigrams(raw) @ lessons.odds) / len(raw) if lessons.odds is not None else 0.0,
        )
    return stats, words


# Classes of documents; what is not clean is bad.
CLEAN, NOISY, REPEATED, TOXIC = range(4)
#: The heuristic labellers in their order, and the class of bad documents that each is meant to find.
LABELLERS = {"symbols": NOISY, "capitals": NOISY, "marks": NOISY, "repetition": REPEATED, "variety": REPEATED, "abuse": TOXIC, "taught": TOXIC, "profile": NOISY}
N_HEURISTICS = len(LABELLERS)


def votes(stats: np.ndarray, lessons: Lessons) -> np.ndarray:
    """Votes of the heuristic labellers, a column each: 0 nothing, ``GOOD`` or ``BAD``.

    None asks for words of particular languages, but the abusive ones. A text too short for a labeller has no vote of it, nor has what lies
    between its two bounds; labellers that were taught nothing are silent.
    """
    symbols, capitals, exclamations, bars, neighbours, variety, abuse, _, _, n, _, _, taught, profile = stats.T
    marks = exclamations + bars
    said = [
        (symbols > 0.3, symbols < 0.1, n >= 3),
        (capitals > 0.4, capitals < 0.15, n >= 3),
        (marks > 0.2, marks < 0.05, n >= 3),
        (neighbours > 0.2, neighbours < 0.05, n >= 10),
        (variety < 0.15, variety > 0.35, n >= 50),
        (abuse >= 2, abuse == 0, n > 0),
        (taught >= 2, taught == 0, (n > 0) & (len(lessons.words) > 0)),
        (profile > 0.02, profile < 0, (n >= 3) & (lessons.odds is not None)),
    ]
    return np.stack([np.where(heard, np.where(bad, BAD, np.where(good, GOOD, 0)), 0) for bad, good, heard in said], axis=1)


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes of a row as one number, in base 3."""
    return (v * 3 ** np.arange(v.shape[1])).sum(1)


class LabelModel:
    """How often each labeller that votes condemns documents of each class (clean, noisy, repeated, toxic), votes being independent within a class.
    Silence says nothing: short texts, on which many are silent, would else be a class of their own.

    Expectation: a document's chances of the classes from its votes. Maximisation: the expected share of each vote in each class, and of each class.
    At the start a labeller is thought to find half of the documents it speaks of and to blame a twentieth of the others; that
    thought counts for a few documents (``PRIOR`` of all). Everything else is learnt from where labellers agree and contradict each other.
    """

    FOUND, BLAMED, SHARES, PRIOR = 0.5, 0.05, (0.85, 0.05, 0.05, 0.05), 0.0005

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200):
        v = patterns[:, None] // 3 ** np.arange(labellers) % 3
        said = np.stack([v == x for x in (GOOD, BAD)], axis=2).astype(float)  # pattern, labeller, vote
        self.n, pseudo = counts.sum(), self.PRIOR * counts.sum() + 1
        meant = np.array([*LABELLERS.values(), -1][:labellers])  # -1: the labels speak of every class
        bad = np.stack([np.where((meant == k) | (meant == -1) & (k != CLEAN), self.FOUND, self.BLAMED) for k in range(4)])
        start = np.stack([1 - bad, bad], axis=2)  # class, labeller, vote
        self.chance, self.share = start, np.array(self.SHARES)
        for _ in range(rounds):
            k = self.classes(v) * counts[:, None]
            self.chance = np.einsum("pk,pjx->kjx", k, said) + pseudo * start
            self.chance = np.clip(self.chance / self.chance.sum(2, keepdims=True), 1e-6, None)
            self.share = (k.sum(0) + pseudo * np.array(self.SHARES)) / (self.n + pseudo)
        k = self.classes(v) * counts[:, None]
        right = k[:, :1] * (v == GOOD) + k[:, 1:].sum(1)[:, None] * (v == BAD)
        #: of each labeller, the expected share of its votes that are right
        self.accuracy = (right.sum(0) + 0.5) / (((v != 0) * counts[:, None]).sum(0) + 1)

    def classes(self, v: np.ndarray) -> np.ndarray:
        """Chances of the classes given votes (a row each, as many columns as labellers or the first of them)."""
        log = np.log(self.share)[None, :] + np.stack([(v == x) @ np.log(self.chance[:, : v.shape[1], x - 1]).T for x in (GOOD, BAD)]).sum(0)
        e = np.exp(log - log.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance of being bad."""
        return self.classes(v)[:, 1:].sum(1)


def features(stats: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of each row: hashed words, then one bucket of each statistic; see :func:`values`."""
    scale = np.array([40, 20, 40, 40, 20, 15, 3, 20, 1, 0, 20, 20, 3, 40])
    b = np.floor(np.log2(1 + np.maximum(stats, 0) * scale) * 3)
    b[:, 9] = np.floor(np.log2(1 + stats[:, 9]))
    b = (np.minimum(b, BUCKETS - 1) + WIDTH + BUCKETS * np.arange(len(STATISTICS))).astype(np.int32)
    return [np.concatenate([np.unique((w % np.uint64(WIDTH)).astype(np.int32)), b[i]]) for i, w in enumerate(words)]


def values(row: np.ndarray) -> np.ndarray:
    """Values of a row's columns: words share a length of one, statistics count one each."""
    n = len(row) - len(STATISTICS)
    x = np.ones(len(row))
    x[:n] = 1 / np.sqrt(max(1, n))
    return x


def train(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, visits: int = 200_000, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by adaptive gradient steps; the last weight is the bias."""
    w, seen = np.zeros(WIDTH + BUCKETS * len(STATISTICS) + 1, dtype=np.float64), np.full(WIDTH + BUCKETS * len(STATISTICS) + 1, 1e-3)
    rng = np.random.default_rng(3)
    for _ in range(min(60, max(8, visits // len(rows)))):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            n = np.array([len(rows[i]) for i in batch])
            at, x = np.concatenate([rows[i] for i in batch]), np.concatenate([values(rows[i]) for i in batch])
            owner = np.repeat(np.arange(len(batch)), n)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[at] * x, minlength=len(batch)) + w[-1], -30, 30)))
            slope = (p - target[batch]) * weight[batch] / len(batch)
            g = np.bincount(at, weights=slope[owner] * x, minlength=len(w))
            g[-1] += slope.sum()
            used = np.flatnonzero(g)
            g = g[used] + ridge * w[used]
            seen[used] += g * g
            w[used] -= 0.15 * g / np.sqrt(seen[used])
    return w.astype(np.float32)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    texts, first, chars = [], 0, 0
    for i in range(batch.num_rows):
        t = batch.column("text")[i].as_py()
        texts.append(t)
        chars += len(t or "")
        if chars > 400_000 or len(texts) >= 2000:
            yield first, texts
            texts, first, chars = [], i + 1, 0
    if texts:
        yield first, texts


def _vote(lessons: Lessons):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch):
                p = pattern(votes(measure(texts, lessons)[0], lessons))
                own = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "h", "size")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p)], ["doc_id", "h", "size", "votes"])

    return run


def _extract(lessons: Lessons):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch):
                rows = features(*measure(texts, lessons))
                own = [batch.column(c).slice(first, len(texts)) for c in ("h", "bad")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in rows], pa.binary())], ["h", "bad", "row"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sort, part, kind``: the distinct words of labelled texts (sort 0), and how often each trigram occurs (sort 1, ``n`` times)."""
    for batch in batches:
        for first, texts in _pieces(batch):
            kinds = np.array(batch.column("kind").slice(first, len(texts)).to_pylist())
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            h, owner = word_hashes([r.translate(_SPLIT) for r in raws])
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            for kind in np.unique(kinds):
                mine = np.flatnonzero(kinds == kind)
                words, held = np.unique(np.concatenate([np.unique(h[cuts[i] : cuts[i + 1]]) for i in mine]), return_counts=True)
                grams = np.sum([_trigrams(raws[i]) for i in mine], axis=0)
                for sort, part, n in ((0, words.view(np.int64), held), (1, np.arange(TRIGRAMS), grams)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sort, dtype=np.int32)), pa.array(part), pa.array([str(kind)] * len(part)), pa.array(n)], ["sort", "part", "kind", "n"])


def _bounded(rows: DataFrame, by: str, limit: int, characters: int) -> DataFrame:
    """Of each value of ``by``, the ``limit`` rows (``h``, ``size``) with the least hashes of ``h`` whose sizes sum to ``characters`` at most; no group meets in one task.

    A row longer than a hundredth of ``characters`` is left out, so that one text is not the sample.
    """
    rows = rows.filter(F.col("size") <= characters // 100)
    order = F.xxhash64("h")
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    level = F.lit(2.0 * limit) / F.col("n") * F.lit(2.0**64) - F.lit(2.0**63)
    few = rows.join(F.broadcast(n), by).filter((F.col("n") <= 2 * limit) | (order.cast("double") <= level))
    w = Window.partitionBy(by).orderBy(order, "h")
    few = few.withColumn("k", F.row_number().over(w)).withColumn("sum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return few.filter((F.col("k") <= limit) & (F.col("sum") <= characters)).drop("n", "k", "sum")


def teach(docs: DataFrame, worst: DataFrame) -> Lessons:
    """Lessons from ``docs`` (``doc_id, h, text``) by ``worst`` (``doc_id, quality, toxic``, a row for each id): at most ``LESSON_ROWS`` rows of each kind."""
    kind = F.when(F.col("toxic") == 1, F.lit("toxic")).when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit("low")).when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("clean"))
    labelled = worst.select("doc_id", kind.alias("kind")).filter("kind IS NOT NULL AND doc_id IS NOT NULL")
    lean = docs.select("doc_id", "h", F.coalesce(F.length("text"), F.lit(0)).alias("size")).join(labelled, "doc_id").select("h", "kind", "size").distinct()
    chosen = materialize(_bounded(lean, "kind", LESSON_ROWS, LESSON_CHARACTERS // 3).select("h", "kind"), "lessons")
    sizes = {r["kind"]: r["n"] for r in chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Lessons()
    texts = join_small(docs.select("h", "text"), chosen, "h", "inner").groupBy("h", "kind").agg(F.first("text").alias("text"))
    parts = texts.select("kind", "text").mapInArrow(tidy(_parts), "sort int, part long, kind string, n long")
    kinds = ("clean", "low", "toxic")
    of = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds]
    counted = materialize(parts.groupBy("sort", "part").agg(*of), "parts")
    words, odds = None, None
    clean, low, toxic = (float(sizes.get(k, 0)) for k in kinds)
    if toxic and clean + low:
        # words that depend on toxicity: the log-likelihood ratio of two binomials against one
        held, others = F.col("toxic"), F.col("clean") + F.col("low")
        expected, rest = (held + others) * (toxic / (toxic + clean + low)), (held + others) * ((clean + low) / (toxic + clean + low))
        term = lambda seen, thought: F.when(seen > 0, seen * F.log(seen / thought)).otherwise(0.0)
        ratio = 2 * (term(held, expected) + term(others, rest))
        often = (held + 0.5) / (toxic + 1) >= TIMES * (others + 0.5) / (clean + low + 1)
        best = counted.filter("sort = 0").withColumn("ratio", ratio).filter(often & (F.col("ratio") >= EVIDENCE)).orderBy(F.desc("ratio"), "part").limit(TAUGHT)
        words = np.array([r["part"] for r in best.select("part").collect()], dtype=np.int64).view(np.uint64)
    if low >= 10 and clean >= 10:
        grams = counted.filter("sort = 1").select("part", "clean", "low").collect()  # TRIGRAMS rows at most
        seen = np.ones((2, TRIGRAMS))
        for r in grams:
            seen[:, r["part"]] += (r["low"], r["clean"])
        odds = np.diff(np.log(seen[::-1] / seen[::-1].sum(1, keepdims=True)), axis=0)[0]
    return Lessons(words, odds)


class Classifier:
    """The label model and the scorer; small enough to travel with a task."""

    def __init__(self, model: LabelModel | None, weights: np.ndarray | None, lessons: Lessons | None = None):
        self.model, self.weights, self.lessons = model, weights, lessons or Lessons()

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the label model's posterior from the heuristics alone, and the scorer's chance of being bad."""
        stats, words = measure(texts, self.lessons)
        if self.weights is None:
            return np.zeros(len(texts)), np.zeros(len(texts))
        z = np.array([float(self.weights[at] @ values(at)) for at in features(stats, words)]) + float(self.weights[-1])
        return self.model.posterior(votes(stats, self.lessons)), 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame | None) -> Classifier:
    """Votes of all rows of ``docs`` (``doc_id, text``), the label model over them, and the scorer."""
    spark = docs.sparkSession
    bounded_batches(spark)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    docs = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("h"), text.alias("text"))
    given, lessons, worst = F.lit(0), Lessons(), None
    if labels is not None:
        worst = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        lessons = teach(docs, worst)
    sized = docs.select("doc_id", "h", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), "text")
    voted = materialize(sized.mapInArrow(tidy(_vote(lessons)), "doc_id long, h long, size long, votes long"), "votes")
    if worst is not None:
        voted = voted.join(worst, "doc_id", "left")
        bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
        given = F.when(bad, BAD).when((F.col("quality") == 1) & (F.col("toxic") == 0), GOOD).otherwise(0)
    whole = voted.select("h", "size", (F.col("votes") + given * 3**N_HEURISTICS).alias("votes"))
    counted = whole.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()  # 3 ** (N_HEURISTICS + 1) rows at most
    if not counted:
        return Classifier(None, None)
    patterns, n = np.array([r["votes"] for r in counted]), np.array([r["n"] for r in counted], dtype=float)
    model = LabelModel(patterns, n, N_HEURISTICS + 1)
    posterior = model.posterior(patterns[:, None] // 3 ** np.arange(N_HEURISTICS + 1) % 3)
    # the sample: as many likely bad as likely good documents, each side thinned by hash
    half = FIT_ROWS / 2
    sides = [max(1.0, n[posterior >= 0.5].sum()), max(1.0, n[posterior < 0.5].sum())]
    share = [min(1.0, half / s) for s in sides]
    known = spark.createDataFrame([(int(p), float(b), float(share[0] if b >= 0.5 else share[1])) for p, b in zip(patterns, posterior, strict=True)], "votes long, bad double, share double")
    chance = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = whole.join(F.broadcast(known), "votes").filter(chance < F.col("share")).groupBy("h").agg(F.max("bad").alias("bad"), F.max("size").alias("size"))
    side = F.col("bad") >= 0.5
    chosen = materialize(_bounded(chosen.withColumn("side", side), "side", FIT_ROWS, FIT_CHARACTERS // 2).select("h", "bad"), "sample")
    # equal rows are one, before anything comes to the driver
    fitted = docs.join(F.broadcast(chosen), "h").mapInArrow(tidy(_extract(lessons)), "h long, bad double, row binary").groupBy("h", "bad").agg(F.min("row").alias("row"))
    sample = fitted.toArrow().sort_by("h")
    rows = [np.frombuffer(r, dtype=np.int32) for r in sample.column("row").to_pylist()]
    if not rows:
        return Classifier(None, None)
    target = sample.column("bad").to_numpy()
    # good documents stand for more than bad ones: the scorer sees them in their true proportion, softened
    weight = np.where(target >= 0.5, 1.0, min(4.0, max(1.0, share[0] / share[1])))
    return Classifier(model, train(rows, target, weight), lessons)


def classify(docs: DataFrame, classifier: Classifier, carry: list[str] | None = None) -> DataFrame:
    """``weak_label, score, rejected`` behind the columns in ``carry``."""
    carry = carry if carry is not None else ["doc_id"]
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _pieces(batch):
                weak, score = shipped.value.score(texts)
                own = [batch.column(c).slice(first, len(texts)) for c in carry]
                yield pa.RecordBatch.from_arrays([*own, pa.array(weak), pa.array(score), pa.array(score >= REJECT)], [*carry, "weak_label", "score", "rejected"])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(run), with_fields(docs, carry, "weak_label double, score double, rejected boolean"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
