"""SimHash fingerprints of 128 bits, with DataFrame functions only.

Terms are the runs of two and of three words of a text (a text of one word is one term, an empty text too); a term weighs as often as it
occurs. Every term's hash votes on every bit: a bit is set if the terms that have it set weigh more than half of all.

Votes are counted four to a long: shifting a hash by i and masking it leaves the bits i, i+16, i+32 and i+48 in fields of 16 bits, so 32 sums of
longs count 128 bits inside generated code. A chunk of at most ``CHUNK`` words cannot overflow a field; chunks are then widened to fields of 32
bits and added. Rows of a document stay in the task that read them, so exploding words causes no shuffle.

Searching within a Hamming radius r cuts the fingerprint into r + 1 blocks; two fingerprints that near agree on a block, so with one table
for every block, led by that block, all of them are found by equality on (table, block). A pair is reported by the first table that holds it.
Equal fingerprints are one entry with a count.

One changed word moves about 10 of 128 bits in a text of 100 words, and fewer in longer ones, so near copies are looked for within ``RADIUS`` bits. There
blocks that agree would be too short to tell anything apart; of 6 blocks of 21 or 22 bits one differs by two bits at most, so a query asks every
table for its block and all blocks up to two bits away. Documents of one fingerprint are a class with one representative, and only representatives are paired.

Defined cases: null text is empty; words are separated by space and 0x09-0x0D; equal texts have equal fingerprints; repeated rows are rows of their
own; null ids come after all others, in descending order of a hash of their text; a single document is its own next; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.shared import materialize

#: Words in a chunk: two terms for each word stay below 2^15 votes a field.
CHUNK = 16_000
#: Rows of a bucket of neighbouring ids, about, and the most buckets.
BUCKET_ROWS, BUCKETS = 2_000, 65_536
FIELDS = 0x0001000100010001
HALVES = 0x0000FFFF0000FFFF
#: Bits within which near copies are looked for, and widths of the blocks of each half of a fingerprint then.
RADIUS, WIDE = 15, (22, 21, 21)
EMPTY = " \t\n\x0b\f\r"


def _or(columns: list[Column]) -> Column:
    """Bitwise or as a balanced tree, which keeps the expression shallow."""
    while len(columns) > 1:
        columns = [reduce(lambda a, b: a.bitwiseOR(b), columns[i : i + 2]) for i in range(0, len(columns), 2)]
    return columns[0]


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fa, fb``: the fingerprint of ``_text`` (not null) of rows told apart by ``keys``, as two longs."""
    words = F.split(F.trim(F.col("_text"), F.lit(EMPTY)), "[\\x20\\x09-\\x0D]+")
    listed = rows.select(*keys, words.alias("_w"))
    each = listed.select(*keys, F.size("_w").alias("_size"), "_w", F.posexplode("_w").alias("_i", "_one"))
    two, three = F.get("_w", F.col("_i") + 1), F.get("_w", F.col("_i") + 2)

    def hashes(salt: list[Column]) -> tuple[Column, Column]:
        pair = F.when(two.isNotNull(), F.xxhash64(*salt, "_one", two)).when(F.col("_size") == 1, F.xxhash64(*salt, "_one")).otherwise(F.lit(0).cast("long"))
        return pair, F.when(three.isNotNull(), F.xxhash64(*salt, "_one", two, three)).otherwise(F.lit(0).cast("long"))

    (a2, a3), (b2, b3) = hashes([]), hashes([F.lit("b")])
    hashed = each.select(*keys, "_size", F.floor(F.col("_i") / CHUNK).cast("int").alias("_chunk"), a2.alias("a2"), a3.alias("a3"), b2.alias("b2"), b3.alias("b3"))
    field = lambda h, i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(FIELDS))
    packed = hashed.groupBy(*keys, "_size", "_chunk").agg(*[F.sum(field(f"{h}2", i) + field(f"{h}3", i)).alias(f"{h}_{i}") for h in "ab" for i in range(16)])
    wide = packed.groupBy(*keys, "_size").agg(
        *[F.sum(F.shiftrightunsigned(f"{h}_{i}", s).bitwiseAND(F.lit(HALVES))).alias(f"{h}_{i}_{s}") for h in "ab" for i in range(16) for s in (0, 16)]
    )
    terms = F.when(F.col("_size") < 3, F.lit(1)).otherwise(2 * F.col("_size") - 3).cast("long")

    def bits(h: str) -> Column:
        set_if = []
        for i in range(16):
            for s in (0, 16):
                for half in (0, 32):
                    votes = F.shiftrightunsigned(f"{h}_{i}_{s}", half).bitwiseAND(F.lit(0xFFFFFFFF))
                    bit = 1 << (i + s + half)
                    set_if.append(F.when(2 * votes > terms, F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0).cast("long")))
        return _or(set_if)

    return wide.select(*keys, bits("a").alias("fa"), bits("b").alias("fb"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of fingerprints in columns ``{a}a, {a}b`` and ``{b}a, {b}b``."""
    differ = F.bit_count(F.col(f"{a}a").bitwiseXOR(F.col(f"{b}a"))) + F.bit_count(F.col(f"{a}b").bitwiseXOR(F.col(f"{b}b")))
    return F.lit(1.0) - differ / F.lit(128.0)


def shown(f: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{f}a"), 16, "0"), F.lpad(F.hex(f"{f}b"), 16, "0")))


def search(queries: DataFrame, entries: DataFrame, radius: int = 3) -> DataFrame:
    """``qa, qb, fa, fb, n``: all entries (``fa, fb, n``) within ``radius`` bits of each distinct query (``qa, qb``).

    With ``radius`` 3 a block has 32 bits, so that a table's key is shared by few fingerprints that are not near.
    """
    n_blocks = radius + 1
    width = 128 // n_blocks
    edges = [i * width for i in range(n_blocks)] + [128]

    def block(a: str, b: str, k: int) -> Column:
        """Bits edges[k] to edges[k + 1], counted from the high end of ``a``, as a long (64 bits at most are used)."""
        lo, hi = edges[k], min(edges[k + 1], edges[k] + 63)
        if hi <= 64:
            return F.shiftrightunsigned(a, 64 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        if lo >= 64:
            return F.shiftrightunsigned(b, 128 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        upper = F.col(a).bitwiseAND(F.lit((1 << (64 - lo)) - 1))
        return F.shiftleft(upper, hi - 64).bitwiseOR(F.shiftrightunsigned(b, 128 - hi))

    def tables(rows: DataFrame, a: str, b: str) -> DataFrame:
        led = F.array(*[F.struct(F.lit(k).alias("t"), block(a, b, k).alias("key")) for k in range(n_blocks)])
        return rows.withColumn("_e", F.explode(led)).select("*", "_e.t", "_e.key").drop("_e")

    q, e = tables(queries.distinct(), "qa", "qb"), tables(entries, "fa", "fb")
    near = F.bit_count(F.col("qa").bitwiseXOR(F.col("fa"))) + F.bit_count(F.col("qb").bitwiseXOR(F.col("fb"))) <= radius
    first = reduce(lambda x, y: x & y, [(q["t"] <= k) | (block("qa", "qb", k) != block("fa", "fb", k)) for k in range(n_blocks)])
    return q.join(e, (q["t"] == e["t"]) & (q["key"] == e["key"]) & near & first).select("qa", "qb", "fa", "fb", "n")


def search_wide(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Columns of both and ``distance``: all entries (``fa, fb``, distinct) within ``RADIUS`` bits of each query (``qa, qb``, distinct)."""
    widths = WIDE * 2
    off = RADIUS // len(widths)

    def block(a: str, b: str, k: int) -> Column:
        i = k % len(WIDE)
        below = 64 - sum(WIDE[: i + 1])
        return F.shiftrightunsigned(a if k < len(WIDE) else b, below).bitwiseAND(F.lit((1 << WIDE[i]) - 1)).cast("int")

    def flips(width: int) -> Column:
        """All changes of up to ``off`` bits."""
        return F.array(*[F.lit(sum(1 << i for i in some)) for n in range(off + 1) for some in combinations(range(width), n)])

    def tables(rows: DataFrame, a: str, b: str) -> DataFrame:
        led = F.array(*[F.struct(F.lit(k).alias("t"), block(a, b, k).alias("key")) for k in range(len(widths))])
        return rows.select("*", F.explode(led).alias("_e")).select(*rows.columns, "_e.t", "_e.key")

    apart = lambda k: F.bit_count(block("qa", "qb", k).bitwiseXOR(block("fa", "fb", k)))
    wide = F.col("t").isin([k for k, w in enumerate(widths) if w == max(widths)])
    q = tables(queries, "qa", "qb").select("*", F.explode(F.when(wide, flips(max(widths))).otherwise(flips(min(widths)))).alias("_flip"))
    q = q.select(*queries.columns, "t", F.col("key").bitwiseXOR(F.col("_flip")).alias("key"))
    e = tables(entries, "fa", "fb")
    distance = F.bit_count(F.col("qa").bitwiseXOR(F.col("fa"))) + F.bit_count(F.col("qb").bitwiseXOR(F.col("fb")))
    first = reduce(lambda x, y: x & y, [(q["t"] <= k) | (apart(k) > off) for k in range(len(widths))])
    return q.join(e, (q["t"] == e["t"]) & (q["key"] == e["key"]) & (distance <= RADIUS) & first).select(*queries.columns, *entries.columns, distance.alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of ``doc_id, text`` with the text of the next document (descending doc_id, the first after the last).

    Ids are cut into buckets at ids that occur, taken from approximate quantiles, and rows without an id likewise by a hash of their text. The row that is a
    bucket's upper bound also goes to the bucket above, as a ghost behind that bucket's last row, and the last of all to the lowest bucket; with this one shuffle
    every row meets its next. Ghosts are kept, marked by ``_ghost``; ``_seq`` numbers a bucket's rows in order.
    """
    nobody = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit(""))))
    ranked = docs.select("doc_id", "text", nobody.alias("_h"))
    # only ids and hashes are gathered here
    n = ranked.agg(F.count("doc_id").alias("ids"), F.max("doc_id").alias("top_id"), F.count("_h").alias("nulls"), F.max("_h").alias("top_null")).collect()[0]

    def bucket(column: str, bounds: list[int]) -> tuple[Column, Column]:
        """The number of the bucket that holds a value, and whether the value is its bound."""
        rows_of = [bounds[i : i + 256] for i in range(0, len(bounds), 256)] or [[0]]
        levels = F.from_json(F.lit(json.dumps(rows_of)), "array<array<bigint>>")
        row = F.size(F.filter(F.from_json(F.lit(json.dumps([r[-1] for r in rows_of])), "array<bigint>"), lambda b: b < F.col(column)))
        inside = F.get(levels, row)
        place = F.size(F.filter(inside, lambda b: b < F.col(column)))
        return row * 256 + place, F.get(inside, place) == F.col(column)  # null where the value is

    def bounds_of(column: str, rows: int, top: int | None) -> list[int]:
        if not rows:
            return []
        buckets = max(1, min(BUCKETS, -(-rows // BUCKET_ROWS)))
        inner = [i / buckets for i in range(1, buckets)]
        near = sorted({*(ranked.agg(F.percentile_approx(column, inner, max(10_000, 4 * buckets)).alias("b")).collect()[0]["b"] if inner else []), top})
        # quantiles are rounded to doubles: the largest value at or below each is one that occurs
        return sorted(r["b"] for r in ranked.filter(F.col(column).isNotNull()).groupBy(bucket(column, near)[0]).agg(F.max(column).alias("b")).collect())

    of_nulls, of_ids = bounds_of("_h", n["nulls"], n["top_null"]), bounds_of("doc_id", n["ids"], n["top_id"])
    bounds = of_nulls + of_ids
    (null_at, null_bound), (id_at, id_bound) = bucket("_h", of_nulls), bucket("doc_id", of_ids)
    is_null = F.col("doc_id").isNull()
    placed = ranked.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), "_h", F.when(is_null, null_at).otherwise(id_at + len(of_nulls)).cast("int").alias("_own"), F.coalesce(F.when(is_null, null_bound).otherwise(id_bound), F.lit(False)).alias("_bound"))
    above = F.when(F.col("_own") + 1 < len(bounds), F.col("_own") + 1).otherwise(F.lit(0))
    here = F.struct(F.col("_own").alias("b"), F.lit(0).alias("g"))
    to = F.when(F.col("_bound"), F.array(here, F.struct(above.alias("b"), F.lit(1).alias("g")))).otherwise(F.array(here))
    dealt = placed.select("doc_id", "text", "_h", F.explode(to).alias("_to")).select("doc_id", "text", "_h", F.col("_to.b").alias("_bucket"), F.col("_to.g").alias("_ghost"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.desc_nulls_last("doc_id"), F.desc("_h"), F.desc("text"))
    return dealt.select("*", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("_seq"))


def edited_texts(paired: DataFrame) -> DataFrame:
    """Adds ``n_chars`` and ``edited``: the last third of the text replaced by as many characters from the start of the next."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    return paired.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = ["_bucket", "_seq", "_ghost", "doc_id", "n_chars"]
    version = lambda which, text, sha: F.struct(F.lit(which).alias("which"), text.alias("t"), sha.alias("sha"))
    own = version(0, F.col("text"), F.lit(""))
    edited = version(1, F.col("edited"), F.sha2(F.col("edited").cast("binary"), 256))
    versions = F.explode(F.filter(F.array(own, edited), lambda v: (v["which"] == 0) | (F.col("_ghost") == 0)))
    two = edited_texts(with_next(docs)).select(*keys, versions.alias("_x"))
    two = two.select(*keys, F.col("_x.which").alias("_which"), F.col("_x.sha").alias("edited_sha256"), F.col("_x.t").alias("_text"))
    found = fingerprints(two, [*keys, "_which", "edited_sha256"])
    pick = lambda c, which: F.max(F.when(F.col("_which") == which, F.col(c)))
    both = found.groupBy(*keys).agg(pick("fa", 0).alias("fa"), pick("fb", 0).alias("fb"), pick("fa", 1).alias("ea"), pick("fb", 1).alias("eb"), pick("edited_sha256", 1).alias("edited_sha256"))
    order = Window.partitionBy("_bucket").orderBy("_seq")
    rows = both.select("*", F.lead("fa").over(order).alias("na"), F.lead("fb").over(order).alias("nb")).filter("_ghost = 0")
    lean = materialize(rows.select("doc_id", "n_chars", "edited_sha256", "fa", "fb", "ea", "eb", "na", "nb"), "simhash")
    # searched: the fingerprints of every hundredth id against all
    entries = lean.groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n"))
    asked = lean.filter(F.col("doc_id") % 100 == 0)
    hits = search(asked.select(F.col("fa").alias("qa"), F.col("fb").alias("qb")), entries)
    per_id = hits.groupBy("qa", "qb").agg(F.sum("n").alias("n_within"))
    counted = asked.select("doc_id", F.col("fa").alias("qa"), F.col("fb").alias("qb")).join(per_id, ["qa", "qb"]).groupBy("doc_id").agg(F.max("n_within").alias("n_within"))
    return lean.join(counted, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", shown("f").alias("fingerprint"), shown("e").alias("edited_fingerprint"), likeness("f", "e").alias("near_edited"), likeness("f", "n").alias("near_next"), "n_within"
    )


def neighbours(docs: DataFrame, asked: Column) -> DataFrame:
    """``doc_id, near_id, distance, near_print``: documents that share a fingerprint are a class, named by its smallest id (null if none has one) and its fingerprint.

    Every document has a row of distance 0 that names its class. Every class with an id that is asked for has a row for each other class within ``RADIUS``
    bits, from the one's smallest id to the other's. What is near a document is therefore the members of its class, of the classes its class names, and no
    others; copies are not paired. Rows equal in id and fingerprint are one document. One without an id is found, but does not make its class be asked for.
    """
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_n", F.monotonically_increasing_id())
    prints = materialize(fingerprints(numbered, ["doc_id", "_n"]).select("doc_id", "fa", "fb").distinct(), "prints")
    wanted = F.coalesce(F.col("doc_id").isNotNull() & asked, F.lit(False))
    classes = materialize(prints.groupBy("fa", "fb").agg(F.min("doc_id").alias("near_id"), F.max(wanted).alias("asked")), "classes")
    queries = classes.filter("asked").select(F.col("near_id").alias("doc_id"), F.col("fa").alias("qa"), F.col("fb").alias("qb"))
    links = search_wide(queries, classes.select("near_id", "fa", "fb")).filter("distance > 0")
    members = prints.join(classes, ["fa", "fb"]).withColumn("distance", F.lit(0))
    return members.unionByName(links, allowMissingColumns=True).select("doc_id", "near_id", "distance", shown("f").alias("near_print"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all documents, and what is near those that hold a hundredth id."""
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), F.col("doc_id") % 100 == 0)


QUERIES = {"op3_simhash": op3_simhash}
#: Registered beside the ten operators.
MORE = {"op3_neighbours": op3_neighbours}
ORACLE: dict[str, str] = {}
