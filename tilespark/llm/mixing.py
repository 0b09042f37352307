"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every source gets a share of all words: weights 1, 2, 3, 1, ... over the sources in code point order (null last), capped at
``max_repeat`` times the source's own size, the excess given to the others by weight until no target is above its cap. A document is expected to
appear ``target / source_size`` times. Documents are put in order within their source, the expected copies are added up along that
order from one offset per source, and a document is emitted once for every integer the running sum crosses.

The order inside a source is (size class, salt, size, hash of id and text): it stratifies by size, which keeps the words taken near the target, and
the (class, salt) groups are small enough to number in one task each even if a source holds a third of all rows. Only hashes, ids, sizes and
sources are shuffled, never texts (but those of rows that repeat others entirely).

Defined cases: null text or text without words has size 0 and may be drawn (it adds no words); a source whose documents are all of
size 0 has target 0 and takes nothing; null source is a source of its own, last; repeated rows are separate documents, and so are rows that share an id or have none; an empty table gives an empty result; other columns are carried through untouched by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.shared import join_small, materialize, word_count

#: Groups into which a (source, size class) pair is dealt by hash: of a source, some 100,000 groups.
SALTS = 256


def _unit(value: Column, seed: int) -> Column:
    """A number in [0, 1) from 32 bits of MD5: the same on every run and in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _size_class(size: Column) -> Column:
    """Classes of sizes that share the number of decimal digits and the two leading digits: sizes in a class differ by a tenth at most."""
    digits = F.length(size.cast("string"))
    return digits * 100 + F.substring(size.cast("string"), 1, 2).cast("int")


def source_targets(sized: DataFrame, max_repeat: int = 3) -> DataFrame:
    """Per source: ``source_size`` and ``target``; one row per source, so the unpartitioned windows run over a tiny table.

    The level at which targets stop growing is found in closed form: with sources ordered by cap over weight, the first k are capped, and k is the
    first for which the level computed from the rest does not exceed the next cap over weight; later ones only have lower levels.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code_point = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighted = sums.withColumn("weight", ((F.row_number().over(by_code_point) - 1) % 3 + 1).cast("long"))
    cap = (F.col("source_size") * max_repeat).cast("long")
    weighted = weighted.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = weighted.withColumn("level", level)
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return levelled.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(final, F.lit(0.0))).alias("target"),
    )


def copies(docs: DataFrame, seed: int = 7, max_repeat: int = 3, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, n_copies`` (plus ``carry``) for every row of ``docs``."""
    carry = carry or []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_text"), *carry)
    # null sources are joined and grouped through a key that no real source has
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = (
        sized.withColumn("_key", key)
        .withColumn("_digest", F.md5(F.concat(F.lit(f"{seed}/"), ident, F.lit("/"), F.col("_text")).cast("binary")))
        .withColumn("_class", _size_class(F.col("size")))
        .withColumn("_salt", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int") % SALTS)
        .drop("_text")
    )
    targets = source_targets(sized, max_repeat).withColumn("_key", key).drop("source")
    groups = keyed.groupBy("_key", "_class", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_key").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_start", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    starts = starts.join(targets, "_key")
    within = Window.partitionBy("_key", "_class", "_salt").orderBy("size", "_digest", F.col("doc_id"))
    rank = F.col("_start") + F.row_number().over(within)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.col("_key"), seed)
    placed = keyed.join(starts, ["_key", "_class", "_salt"]).withColumn("_rank", rank).withColumn("_rate", rate)
    crossed = F.floor(offset + F.col("_rank") * F.col("_rate")) - F.floor(offset + (F.col("_rank") - 1) * F.col("_rate"))
    n = F.least(F.lit(max_repeat), crossed).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", n.alias("n_copies"), *carry)


def mix(docs: DataFrame, seed: int = 7, max_repeat: int = 3) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is drawn, all columns kept.

    Rows travel with their texts only if they are drawn at least once: the draw is made on lean rows and joined back by a hash of the whole row (two of 64 bits).
    Rows that are equal in everything are interchangeable: one of them is emitted as often as all of them are drawn together.
    """
    named = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    # maps have no hash of their own
    parts = [F.to_json(F.struct(F.col(n))) if "map<" in k else F.col(n) for n, (_, k) in zip(named, docs.dtypes, strict=True)]
    keyed = docs.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(named)], *[F.xxhash64(F.lit(k), *[F.isnull(p) for p in parts], *parts).alias(f"_mix_{k}") for k in (1, 2)])
    keys = ["_mix_1", "_mix_2"]
    at = {c: F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "source", "text")}
    drawn = copies(keyed.select(*at.values(), *keys), seed, max_repeat, carry=keys)
    drawn = materialize(drawn.groupBy(*keys).agg(F.sum("n_copies").cast("int").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows")).filter("_mix_copies > 0"), "drawn")
    single = join_small(keyed, drawn.filter("_mix_rows = 1").drop("_mix_rows"), keys, "inner")
    several = join_small(keyed, drawn.filter("_mix_rows > 1").drop("_mix_rows"), keys, "inner")
    own = [f"c{i}" for i in range(len(named))]
    # one of equal rows, chosen before anything is shuffled
    one = several.groupBy(*keys, "_mix_copies").agg(F.first(F.struct(*own)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in own], "_mix_copies")
    emitted = single.select(*own, "_mix_copies").unionByName(one).select(*own, F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return emitted.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS text_md5 FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 3 * source_size AS cap,
    (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM sums),
ratios AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM weighted),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
      / CAST((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), weight * coalesce((SELECT max(level) FROM levels WHERE level <= ratio), 0)) AS target FROM levels),
keyed AS (
  SELECT *, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k,
    md5('7/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || text_md5) AS digest,
    len(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INT) AS class FROM sized),
salted AS (SELECT *, CAST('0x' || substr(digest, 1, 2) AS INT) AS salt FROM keyed),
ranked AS (
  SELECT doc_id, size, k, source,
    row_number() OVER (PARTITION BY k ORDER BY class, salt, size, digest, doc_id) AS r,
    CAST(CAST('0x' || substr(md5('7:' || k), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM salted),
rated AS (
  SELECT doc_id, size, source_size, target, r, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  CAST(least(3, CAST(floor(u + r * rate) - floor(u + (r - 1) * rate) AS BIGINT)) * size AS BIGINT) AS taken
FROM rated
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLE = {"op8_mixing": OP8_SQL}
