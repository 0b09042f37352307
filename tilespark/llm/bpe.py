"""BPE encoding and decoding with a table of distinct words.

Texts are normalised and split into words by the rules in the tokenizer's own file. Texts are taken in blocks, and a block keeps each of its words once:
its texts become arrays of numbers into the block's list of words. From there on everything is a join, at every size:

1. the lists of all blocks give the table of distinct words, each of which is encoded once;
2. ids of a distinct word are joined to the vocabulary (id to piece, a table of fixed size), which decodes it;
3. (block, position, word) rows meet ids and pieces by word, and go back to their block, where position k of the list stands for every k in its texts.

A block's list is bounded in words, so tasks hold some tens of megabytes whatever the corpus; a word occurs once a block at most, so that no word, however
frequent, is more than one row of each block's list; neither texts nor their numbers are shuffled: blocks are written in buckets, and lists come to them.

Defined cases: null text is empty (no ids); texts of any length are taken whole; repeated rows are encoded each; an empty
table gives an empty result; other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilespark.llm.shared import bounded_batches, materialize_buckets, tidy, with_fields

#: A block of texts is closed at so many distinct words, characters or texts.
BLOCK_WORDS, BLOCK_CHARS, BLOCK_TEXTS = 400_000, 24_000_000, 50_000
#: Words with ids that a task packs at a time; characters of output it makes at a time.
PACKED_WORDS, OUT_CHARS = 200_000, 1_000_000


class Splitter:
    """What a tokenizer file says about turning a text into words, for the kinds of steps that the file uses.

    Special tokens are cut out first; each part between them is normalised (NFC, white space, lower case) and searched by the split pattern. The
    common case is done by Python's own string functions; characters on which these and the library could differ are left
    to the library's normaliser.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        self._definition, self._tokenizer = definition, None
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in split] != ["Split", "ByteLevel"] or not split[0]["invert"]:
            raise ValueError("this kind of tokenizer file is not known here")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = split[0]["pattern"]["Regex"]
        self._words = regex.compile(pattern)
        # lower-case ASCII texts go by the quicker engine where the pattern's only classes are letters and numbers, in brackets
        plain = re.sub(r"\[(\^\\s)?((?:\\p\{[LN]\})+)\]", lambda m: f"[{m[1] or ''}{m[2]}]".replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), pattern)
        self._ascii = None if r"\p" in plain else re.compile(plain, re.ASCII)
        by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self._pieces = [by_id.get(i) for i in range(max(by_id) + 1)]
        self._plain = re.compile("[\x00-įı-ɏ‐-‧‰-⁞₠-₿]*")

    @property
    def tokenizer(self) -> Tokenizer:
        """The library's tokenizer, made when it is first needed: tasks that only look words up do without."""
        if self._tokenizer is None:
            self._tokenizer = Tokenizer.from_str(self._definition)
        return self._tokenizer

    def normalise(self, part: str) -> str:
        if part.isascii():
            return part.lower()
        if self._plain.fullmatch(part):
            return unicodedata.normalize("NFC", part).lower()
        return self.tokenizer.normalizer.normalize_str(part)

    def words(self, text: str | None) -> list[str]:
        """The words of a text in order; a special token is a word of its own, told from others by a leading space, which no word has."""
        if not text:
            return []
        if "<|" not in text:
            return self._split(self.normalise(text))
        found: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            found += [" " + part] if k % 2 else self._split(self.normalise(part))
        return found

    def _split(self, part: str) -> list[str]:
        return (self._ascii if self._ascii and part.isascii() else self._words).findall(part)

    def encode(self, word: str) -> list[int]:
        """Ids of one distinct word."""
        if word.startswith(" "):
            return [self.special[word[1:]]]
        return [i for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word) for i in (t.id for t in self.tokenizer.model.tokenize(piece))]

    def pieces(self) -> list[str]:
        return self._pieces


_splitters: dict[str, Splitter] = {}


def splitter(definition: str) -> Splitter:
    """One per process and definition."""
    key = hashlib.md5(definition.encode()).hexdigest()
    if key not in _splitters:
        _splitters[key] = Splitter(definition)
    return _splitters[key]


def _planes(numbers: np.ndarray) -> list[bytes]:
    """Numbers (int32) as four planes of bytes, each compressed: the upper planes are nearly empty."""
    raw = numbers.view(np.uint8)
    return [pa.compress(raw[i::4].tobytes(), codec="zstd", asbytes=True) for i in range(4)]


def _from_planes(planes: list[bytes], n: int) -> np.ndarray:
    numbers = np.empty(n, dtype=np.int32)
    for i, plane in enumerate(planes):
        numbers.view(np.uint8)[i::4] = np.frombuffer(pa.decompress(plane, n, codec="zstd"), np.uint8) if n else 0
    return numbers


def _renumber(flat: np.ndarray, words: pa.Array) -> pa.Array:
    """Frequent words get small numbers, in place, and words of like frequency stand in their own order: both pack well."""
    n = np.bincount(flat, minlength=len(words))
    place = np.empty(len(words), dtype=np.int32)
    place[np.argsort(-n, kind="stable")] = np.arange(len(words))
    order = pc.sort_indices(pa.table({"tier": (place > 255).astype(np.int8) + (place > 65_535), "word": words}), [("tier", "ascending"), ("word", "ascending")])
    place[order.to_numpy()] = np.arange(len(words))
    np.take(place, flat, out=flat)
    return words.take(order)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def blocks_of(docs: DataFrame, definition: str, carry: list[str], block_chars: int) -> DataFrame:
    """One row of every block, in buckets by block: ``block, rows`` (the columns in ``carry`` with each text's number of words, packed), ``codes`` (the numbers
    of its texts' words, packed) and ``words``, its list."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = splitter(definition), TaskContext.get().partitionId() << 32
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        parts, codes, lengths, chars = [], [], [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).append_column("_n", pa.array(lengths, pa.int32()))
            flat, words = np.concatenate(codes), pa.array(number, pa.string(), size=len(number))
            codes.clear()
            number.clear()
            words = _renumber(flat, words)
            lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            columns = [pa.array([block]), pa.array([_packed(rows)], pa.binary()), pa.array([_planes(flat)], pa.list_(pa.binary())), lists]
            return pa.RecordBatch.from_arrays(columns, ["block", "rows", "codes", "words"])

        for batch in batches:
            own, text, first = batch.drop_columns(["_text"]), batch.column("_text"), 0
            for i in range(batch.num_rows):
                t = text[i].as_py()
                words = split.words(t)
                codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                lengths.append(len(words))
                chars += len(t or "")
                if len(number) >= BLOCK_WORDS or chars >= block_chars or len(lengths) >= BLOCK_TEXTS:
                    parts.append(own.take(np.arange(first, i + 1)))
                    yield out()
                    parts, lengths, chars, first, block = [], [], 0, i + 1, block + 1
            if first < batch.num_rows:
                parts.append(own.take(np.arange(first, batch.num_rows)))  # a copy: a slice would hold the texts
        if parts:
            yield out()

    # names of carried columns are set aside: any may clash
    lean = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(carry)], F.lit(True).alias("_row"), F.col("text").alias("_text"))
    return materialize_buckets(lean.mapInArrow(tidy(code), "block long, rows binary, codes array<binary>, words array<string>"), "bpe-blocks", "block")


def word_table(words: DataFrame, definition: str) -> DataFrame:
    """``word, ids, said`` of every distinct word of ``words`` (``block, k, word``): encoded once, decoded by a join of its ids to their pieces.

    A word's first place is found as well, only so that this reads the very rows that the ids are joined to: they are shuffled once.
    """
    spark = words.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(definition)
        for batch in batches:
            ids = pa.array([split.encode(w) for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids], ["word", "ids"])

    pieces = splitter(definition).pieces()
    if any("\n" in p for p in pieces if p):
        raise ValueError("pieces that hold a line break are not known here")
    vocabulary = spark.createDataFrame(list(enumerate(pieces)), "id int, piece string")  # a fixed size
    # from here on by hash of the word: tokens of a word are put together, and the word is joined, without another shuffle
    first = words.groupBy("word").agg(F.min(F.struct("block", "k")).alias("first"))
    encoded = first.mapInArrow(tidy(encode), "word string, ids array<int>").repartition("word")
    tokens = encoded.select("word", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(vocabulary), "id", "left")
    in_order = tokens.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id", "piece")))).alias("t"))
    joined = lambda c: F.array_join(F.transform("t", lambda x: x[c].cast("string")), " ")
    return in_order.select("word", joined("id").alias("ids"), joined("piece").alias("said"))


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block that a task holds, in one row."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().sort_by([("block", "ascending"), ("k", "ascending")])
        block, k = table.column("block").to_numpy(), table.column("k").to_numpy()
        cuts = np.concatenate([np.flatnonzero(np.diff(block, prepend=block[0] - 1)), [len(block)]])
        texts = [pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), table.column(c).combine_chunks()), "\n") for c in ("ids", "said")]
        packed = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            steps = np.diff(k[a:b], prepend=np.int32(0)).astype(np.int32)
            packed.append(_packed(pa.table({"n": [len(steps)], "k": pa.array([_planes(steps)], pa.list_(pa.binary())), "ids": texts[0].slice(i, 1), "said": texts[1].slice(i, 1)})))
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(packed, pa.binary())], ["block", "part"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACKED_WORDS:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _list(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of a block's list: how many ids, the ids, the pieces."""
    k, ids, said = [np.zeros(0, np.int32)], [], []
    for raw in parts:
        row = _unpacked(raw).to_pylist()[0]
        k.append(np.cumsum(_from_planes(row["k"], row["n"]), dtype=np.int32))
        ids += row["ids"].split("\n")
        said += row["said"].split("\n")
    n = np.array([x.count(" ") + 1 if x else 0 for x in ids], dtype=np.int32)
    order = np.argsort(np.concatenate(k))
    return n[order], np.array(ids, dtype=object)[order], np.array(said, dtype=object)[order]


def encode_decode(docs: DataFrame, definition: str, carry: list[str] | None = None, digests: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each row's ids and decoded text: ``n_tokens, ids, decoded`` behind the columns in ``carry``.

    ``ids`` are decimal ids joined by one space and ``decoded`` is the text of the pieces. With ``digests`` both are replaced by their
    SHA-256, ``ids_sha256, decoded_sha256``, before they leave the task. Smaller blocks (``block_chars``) take less memory and more room on disk.
    """
    carry = carry if carry is not None else ["doc_id"]
    bounded_batches(docs.sparkSession)
    blocks = blocks_of(docs, definition, carry, block_chars)
    entries = blocks.select("block", F.posexplode("words").alias("k", "word")).filter(F.col("word").isNotNull()).repartition("word")
    found = entries.join(word_table(entries, definition), "word").select("block", "k", "ids", "said")
    lists = found.mapInArrow(tidy(_pack_words), "block long, part binary").groupBy("block").agg(F.collect_list("part").alias("parts"))  # the list of one block
    met = blocks.select("block", "rows", "codes").join(lists, "block", "left")
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digests else (lambda s: s)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, parts = _unpacked(batch.column("rows")[i].as_py()), batch.column("parts")[i].as_py()
                n, ids, said = _list(parts or [])
                cuts = np.concatenate([[0], np.cumsum(rows.column("_n").to_numpy())])
                flat = _from_planes(batch.column("codes")[i].as_py(), int(cuts[-1]))
                made, first, chars = [], 0, 0
                for k in range(rows.num_rows):
                    own = flat[cuts[k] : cuts[k + 1]]
                    own = own[n[own] > 0]
                    x, y = " ".join(ids[own].tolist()), " ".join(said[own].tolist())
                    made.append((int(n[own].sum()), shown(x), shown(y)))
                    chars += len(made[-1][1]) + len(made[-1][2])
                    if chars >= OUT_CHARS or k + 1 == rows.num_rows:
                        kept = [rows.column(f"c{c}").slice(first, k + 1 - first).combine_chunks() for c in range(len(carry))]
                        columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                        yield pa.RecordBatch.from_arrays(kept + columns, carry + names)
                        made, first, chars = [], k + 1, 0

    return met.select("rows", "codes", "parts").mapInArrow(tidy(finish), with_fields(docs, carry, f"n_tokens long, {names[1]} string, {names[2]} string"))


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """Adds ``decoded`` to rows with an array ``ids``, by a join to the pieces (a table of fixed size)."""
    spark = encoded.sparkSession
    vocabulary = spark.createDataFrame(list(enumerate(splitter(definition).pieces())), "_id int, _piece string")
    numbered = encoded.withColumn("_row", F.monotonically_increasing_id())
    tokens = numbered.select("_row", F.posexplode("ids").alias("_k", "_id")).join(F.broadcast(vocabulary), "_id")
    texts = tokens.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_piece"))), lambda x: x["_piece"]), " ").alias("decoded"))
    return numbered.join(texts, "_row", "left").select(*encoded.columns, F.coalesce("decoded", F.lit("")).alias("decoded"))


def definition_of(path: str) -> str:
    """The tokenizer file's text, read on the driver; its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_definition() -> str:
    import public_tokenizers

    return definition_of(public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_definition(), digests=True)


QUERIES = {"op7_bpe": op7_bpe}
ORACLE: dict[str, str] = {}
