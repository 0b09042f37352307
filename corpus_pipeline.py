"""The corpus pipeline: from raw documents to token ids.

Each stage takes the documents its predecessor kept and returns documents with the same columns, except the last, which returns token ids. A stage
is a thin call of one operator; other columns travel through it untouched, whatever their names.

Defined cases, in every stage: null text is empty and stays null; empty and very long texts are taken whole; documents without an id, or with one that others have,
are documents of their own; of rows equal in id and text one stays after the second stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import bpe, mixing, neardup, quality, repeats
from tilespark.llm.shared import join_small, materialize

#: SQL cannot express the classifier or the tokenizer. A test compares all rows of run() with brute force on a small corpus, given the fitted classifier and the draws.
ORACLE_SQL = None


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _packed(docs: DataFrame) -> DataFrame:
    """Ids and texts, and all other columns in one, so that no column's name can clash with an operator's and no text travels twice."""
    rest = [F.col(_quoted(c)).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNotNull().alias("has text")).alias("_rest"))


def _unpacked(rows: DataFrame, like: DataFrame, text: str = "text") -> DataFrame:
    """Rows with the columns of ``like``; ``text`` names the column that holds the texts."""
    own = {"doc_id": F.col("doc_id"), "text": F.when(F.col("_rest.`has text`"), F.col(text))}
    if text != "text":
        own["n_chars"] = F.length(own["text"]).cast("long")
    return rows.select(*[own[c].alias(c) if c in own else F.col(f"_rest.{_quoted(c)}").alias(c) for c in like.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    classifier = quality.fit(docs, labels)
    return _unpacked(quality.classify(_packed(docs), classifier, carry=["doc_id", "text", "_rest"]).filter("NOT rejected"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8 or more): the smallest id, documents without an id coming last.

    Documents are told apart by id and text, so texts that share an id, or have none, are documents of their own; rows equal in both are one.
    """
    h = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    found = neardup.near_duplicates(docs.select(h.alias("doc_id"), "text"), k=5, percent=80).groupBy(F.col("doc_id").alias("_h"))
    seen = materialize(found.agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component")).filter("n > 1 OR _h <> component"), "flags")
    linked = seen.filter("_h <> component").select("_h", "component")
    members = materialize(linked.unionByName(linked.select(F.col("component").alias("_h"), "component")).distinct(), "members", of=seen)
    named = join_small(docs.select(h.alias("_h"), F.col("doc_id").cast("long").alias("_id")), members, "_h", "inner")
    stays = named.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("nobody"), "_id", "_h")).alias("s")).select("component", F.col("s._h").alias("_stays"))
    gone = materialize(members.join(stays, "component").filter("_h <> _stays").select(F.col("_h").alias("_gone")), "gone", of=members)
    left = join_small(docs, gone, h == F.col("_gone"), "left_anti")
    repeated = materialize(seen.filter("n > 1").select(F.col("_h").alias("_again")), "again", of=seen)
    if not repeated.limit(1).count():
        return left
    packed = _packed(left).withColumn("_h", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    again = join_small(packed, repeated, F.col("_h") == F.col("_again"), "left_semi")
    # one of equal rows is chosen before anything is shuffled
    one_each = again.groupBy("_h").agg(F.min_by(F.struct("doc_id", "text", "_rest"), F.xxhash64("_rest")).alias("d")).select("d.*")
    return join_small(left, repeated, h == F.col("_again"), "left_anti").unionByName(_unpacked(one_each, docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur more than once in all documents."""
    return _unpacked(repeats.without_repeats(_packed(docs), carry=["doc_id", "_rest"]), docs, text="kept")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources weigh 1, 2, 3, ...; a document drawn twice is there twice."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decoded``: token ids, in decimal and joined by a space, and the text of their pieces."""
    carry = [c for c in ("doc_id", "source") if c in docs.columns]
    return bpe.encode_decode(docs, bpe.default_definition(), carry=carry, block_chars=8_000_000)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
