"""Removal of repeated passages over all documents, with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else. What cannot be part of such a string is
put aside before anything is sorted:

1. Each window of ``length`` bytes has an anchor: the place in it whose next ``GRAM`` bytes hash least, the first of equals. Windows with
   equal bytes have equal anchors at equal places, so only windows with equal anchors can be equal. The windows of one anchor are consecutive; they
   and their bytes are the anchor's cell, about one cell for 80 bytes. Text of a short period makes a cell for each period, all of one kind: cells of one kind that
   follow one another in a document are one row with the number of ``times``.
2. Anchors that occur once are put aside. Of the cells of the others one of each kind (anchor and cell hash) goes with its bytes and its multiplicity, the number
   of its places, to a shard chosen by its anchor: a passage with thousands of copies is sorted once.
3. The shard's suffix array (two-stage sorting, see ``suffix_array``) with adjacent common prefixes decides: suffixes that agree over ``length`` bytes are one
   string, which occurs as often as the multiplicities of their cells add up to. Strings that occur twice are spans of their kinds, and a join gives them to all
   places, one row for cells that follow one another: a kind that does so occurs twice, so its span is the whole cell, and those of its neighbours touch. Every window
   lies in one cell, so it is never compared with itself.
4. An anchor with more than ``HOT`` kinds would make its shard unbounded: its windows are added up one by one, by
   128-bit hash, in an aggregation over all tasks. That is exact as well.

Documents are told apart by id and a hash of id and text (by two hashes, where there is no id), and runs of removed bytes are joined back by them: rows that
share an id, or have none, do not meet.

Cells of a kind are equal by hash (64 bits within an anchor's 64), strings of different kinds by their bytes: that is exact up to collisions of hashes.

Defined cases: null text is empty; texts shorter than ``length`` keep all; a row repeated with the same id and text repeats everything in it; rows with
one id and different texts are different documents, those without an id too; an empty table gives an empty result; other
columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.llm.shared import bounded_batches, join_small, materialize, partitions, remove, tidy, with_fields
from tilespark.llm.shingles import mix
from tilespark.llm.suffix_array import common_prefixes, suffix_array

U = np.uint64
#: Bytes hashed for an anchor; bytes of a shard, about; different cells of one anchor that go to a shard at most; bytes hashed at a time.
GRAM, SHARD_BYTES, HOT, PIECE_BYTES = 40, 500_000, 4_000, 400_000
#: Stands behind every cell in a shard; no UTF-8 text holds it.
SEPARATOR = 0xFF
#: How the cells wanted of a document are packed.
WANTED = np.dtype([("anchor", "<i8"), ("cell", "<i8"), ("n", "<i8"), ("hot", "?"), ("first", "<i8"), ("many", "<i4")])

_rng = np.random.default_rng(19700101)
_BYTES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
_BASES = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F]
_power_cache: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _power_cache or len(_power_cache[base]) < n:
        p = np.full(max(n, PIECE_BYTES + 200_000), base, dtype=np.uint64)
        p[0] = 1
        _power_cache[base] = np.multiply.accumulate(p)
    return _power_cache[base][:n]


class Rolling:
    """Hashes of any range of bytes of a buffer; ``which`` chooses one of two independent families."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        base = _BASES[which]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[which][raw] * _power(base, len(raw)), dtype=np.uint64)])
        self.down = _power(pow(base, -1, 2**64), len(raw) + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """Of the ``n`` bytes from every place that has as many."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n] + U(n))


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of ``x[i : i + n]`` for every i."""
    m, have = x, 1
    while have * 2 <= n:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - have :][: len(x) - n + 1])


def cells(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cells of the documents ``raw[starts[i] : ends[i]]``: document, first window, number of windows, anchor hash, cell hash."""
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) < length:
        return none
    roll = Rolling(raw)
    grams = roll.windows(GRAM)
    # 40 bits of hash, then the place: the least is the first of equals
    ranked = (grams & ~U(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(ranked, length - GRAM + 1) & U(0xFFFFFF)).astype(np.int64)
    n = np.maximum(ends - starts - length + 1, 0)
    doc = np.repeat(np.arange(len(starts)), n)
    window = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    if not len(window):
        return none
    a = anchor[window]
    opens = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    many = np.diff(np.concatenate([opens, [len(a)]]))
    first, doc, a = window[opens], doc[opens], a[opens]
    cell = roll.ranges(first, first + many + (length - 1))
    cell = mix(cell + mix((a - first).astype(np.uint64) * U(0x100000001B3)))
    return doc, first - starts[doc], many, grams[a], cell


def _own_names(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Id, text and the hash that tells documents apart, behind carried columns; names set apart from any that documents have."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    named = F.coalesce(doc_id, F.xxhash64(F.lit("no id"), text))
    return docs.select(*carry, named.alias("_doc"), F.xxhash64(doc_id, text).alias("_doc_key"), text.alias("_doc_text"))


def _texts(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(row, id, key, bytes) of a batch in runs of bounded size; a text longer than that is a run of its own."""
    run, held = [], 0
    ids, keys, column = batch.column("_doc").to_pylist(), batch.column("_doc_key").to_pylist(), batch.column("_doc_text")
    for i in range(batch.num_rows):
        raw = (column[i].as_py() or "").encode("utf-8")
        if held + len(raw) > PIECE_BYTES and run:
            yield run
            run, held = [], 0
        run.append((i, ids[i], keys[i], raw))
        held += len(raw)
    if run:
        yield run


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), starts, starts + n


def _find_cells(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _texts(batch):
                rows = [r for r in rows if len(r[3]) >= length]
                if not rows:
                    continue
                if max(len(r[3]) for r in rows) >= 1 << 24:  # the place of an anchor has 24 bits
                    yield from _long_cells(rows, length)
                    continue
                ids, keys = (np.array([r[c] for r in rows], dtype=np.int64) for c in (1, 2))
                doc, first, many, anchor, cell = cells(*_joined([r[3] for r in rows]), length)
                yield _cell_rows(ids, keys, doc, first, many, anchor, cell)

    return run


def _cell_rows(ids, keys, doc, first, many, anchor, cell) -> pa.RecordBatch:
    """A row for each run of cells of one kind in a document, which follow one another without a gap."""
    same = (doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1]) & (cell[1:] == cell[:-1])
    opens = np.flatnonzero(np.concatenate([[True], ~same])[: len(doc)])
    times = np.diff(np.concatenate([opens, [len(doc)]]))
    doc, at = doc[opens], (first << 20 | many)[opens]
    columns = [ids[doc], keys[doc], at, times, anchor[opens].view(np.int64), cell[opens].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in columns], ["id", "key", "at", "times", "anchor", "cell"])


def _long_cells(rows, length: int) -> Iterator[pa.RecordBatch]:
    """Texts of 16 MB or more in stretches of windows; a cell cut by a stretch's border is found in two parts, which only matters to how it is
    grouped: borders are placed where an anchor changes."""
    step = 1 << 23
    for _, ids, keys, raw in rows:
        lo = 0
        while lo + length <= len(raw):
            part = np.frombuffer(raw, dtype=np.uint8)[lo : lo + step]
            _, first, many, anchor, cell = cells(part, np.array([0]), np.array([len(part)]), length)
            last = lo + step >= len(raw)
            n = len(first) if last else len(first) - 1
            yield _cell_rows(np.array([ids]), np.array([keys]), np.zeros(n, dtype=np.int64), first[:n] + lo, many[:n], anchor[:n], cell[:n])
            if last:
                break
            lo += int(first[-1])


def _spans(anchors, kinds, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, dtype=np.int64)) for x in (anchors, kinds, starts, ends)], ["anchor", "cell", "from", "to"])


def _shard_spans(length: int):
    """Strings that occur twice in a shard, as spans of bytes of the kinds that hold them; rows come sorted by shard."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.frombuffer(r[3], dtype=np.uint8) for r in rows]
        sizes = np.array([len(p) + 1 for p in parts])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        text = np.full(sizes.sum(), SEPARATOR, dtype=np.uint8)
        for p, b in zip(parts, begin.tolist(), strict=True):
            text[b : b + len(p)] = p
        # suffixes that begin a window of their cell; what runs over a separator is no string of a document
        ends = np.repeat(begin + sizes - 1, sizes)
        windows = np.arange(len(text)) + length <= ends
        order = suffix_array(text, length)
        order = order[windows[order]].astype(np.int64)
        anchors, kinds, n = (np.array([r[c] for r in rows], dtype=np.int64) for c in (0, 1, 2))
        # neighbours that share the whole length are one string; its places are those of all cells that hold it
        opens = common_prefixes(text, order, length) < length
        opens[:1] = True
        owner = np.searchsorted(begin, order, side="right") - 1
        occurs = np.add.reduceat(n[owner], np.flatnonzero(opens)) if len(order) else n[:0]
        places = np.sort(order[occurs[np.cumsum(opens) - 1] > 1])
        owner = np.searchsorted(begin, places, side="right") - 1
        if not len(places):
            return _spans([], [], [], [])
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(places) > 1) | (np.diff(owner) > 0)]))
        last = np.concatenate([opens[1:], [len(places)]]) - 1
        own = owner[opens]
        return _spans(anchors[own], kinds[own], places[opens] - begin[own], places[last] + length - begin[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "anchor", "cell", "n", "bytes")]
            for s, *row in zip(*columns, strict=True):
                if s != shard:
                    if rows:
                        yield solve(rows)
                    shard, rows = s, []
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """``id, key, start, end``: spans of bytes to remove, as they are found (they may overlap); ``id`` is doc_id, or a hash for null, ``key`` the hash of id and text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = _own_names(docs, [])
    found = materialize(docs.mapInArrow(tidy(_find_cells(length)), "id long, key long, at long, times long, anchor long, cell long"), "cells")
    anchors = found.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    again = materialize(found.join(materialize(anchors, "anchors"), "anchor"), "cells-again")
    remove(found)
    # one place of each kind, whichever comes first: all have the same bytes
    some = [F.first(c).alias(c) for c in ("id", "key", "at")]
    kinds = materialize(again.groupBy("anchor", "cell").agg(F.sum("times").alias("n"), *some), "kinds")
    crowded = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > HOT).select("anchor", F.lit(True).alias("crowded")), "crowded")
    first, many = F.shiftright("at", 20), F.col("at").bitwiseAND(F.lit((1 << 20) - 1))
    cell = F.struct("anchor", "cell", "n", F.coalesce("crowded", F.lit(False)).alias("hot"), first.alias("first"), many.alias("many"))

    # the bytes of those cells, from the documents that have them
    wanted = join_small(kinds, crowded, "anchor", "left").groupBy("id", "key").agg(F.collect_list(cell).alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            inner, cut = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            rows = np.zeros(len(inner), dtype=WANTED)
            for c in WANTED.names:
                rows[c] = inner.field(c).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["_doc", "_doc_key", "wanted"])

    wanted = materialize(wanted.mapInArrow(tidy(pack), "_doc long, _doc_key long, wanted binary"), "wanted")
    holders = docs.join(wanted, ["_doc", "_doc_key"]).select("_doc", "_doc_key", "_doc_text", "wanted")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "cell", "n", "hot", "bytes"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for run in _texts(batch):
                for i, _, _, raw in run:
                    for anchor, cell, n, is_hot, first, windows in np.frombuffer(batch.column("wanted")[i].as_py(), dtype=WANTED).tolist():
                        part = raw[first : first + windows + length - 1]
                        rows.append((anchor, cell, n, is_hot, part))
                        held += len(part)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    parts = materialize(holders.mapInArrow(tidy(take), "anchor long, cell long, n long, hot boolean, bytes binary"), "parts")
    usual = parts.filter(~F.col("hot"))
    size = usual.agg(F.sum(F.length("bytes"))).collect()[0][0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    # rows that repeat a document bring its cells again: each kind stands once
    dealt = usual.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = dealt.repartition(max(partitions(spark), min(shards, 10_000)), "shard").dropDuplicates(["shard", "anchor", "cell"]).sortWithinPartitions("shard")
    spans = dealt.select("shard", "anchor", "cell", "n", "bytes").mapInArrow(tidy(_shard_spans(length)), "anchor long, cell long, from long, to long")

    hot = parts.filter("hot")
    if hot.limit(1).count():

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    raw = np.frombuffer(batch.column("bytes")[i].as_py(), dtype=np.uint8)
                    h = [Rolling(raw, w).windows(length).view(np.int64) for w in (0, 1)]
                    m = len(h[0])
                    same = [np.full(m, batch.column(c)[i].as_py(), dtype=np.int64) for c in ("anchor", "cell", "n")]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, np.arange(m), h[0], h[1])], ["anchor", "cell", "n", "from", "h1", "h2"])

        single = hot.dropDuplicates(["anchor", "cell"]).select("anchor", "cell", "n", "bytes").repartition(partitions(spark))
        hashed = materialize(single.mapInArrow(tidy(windows), "anchor long, cell long, n long, from long, h1 long, h2 long"), "windows")
        twice = materialize(hashed.groupBy("h1", "h2").agg(F.sum("n").alias("places")).filter("places > 1").select("h1", "h2"), "twice")
        # a cell has few windows; those that follow one another are one span
        of_kind = Window.partitionBy("anchor", "cell").orderBy("from")
        more = join_small(hashed, twice, ["h1", "h2"], "inner").withColumn("run", F.col("from") - F.row_number().over(of_kind))
        more = more.groupBy("anchor", "cell", "run").agg(F.min("from").alias("from"), (F.max("from") + length).alias("to"))
        spans = spans.unionByName(more.drop("run"))

    # what was found for a kind holds at all its places; in a run the last cell's end is the end
    spans = materialize(spans, "kind-spans")
    last = first + (F.col("times") - 1) * many
    return join_small(again, spans, ["anchor", "cell"], "inner").select("id", "key", (first + F.col("from")).alias("start"), (last + F.col("to")).alias("end"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs from (start, end) rows; runs that touch are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    opens = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[opens, 0], reach[np.concatenate([opens[1:], [len(spans)]]) - 1]], axis=1)


def without_repeats(docs: DataFrame, length: int = 200, carry: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Every row with ``kept`` (the text without repeated passages), ``n_bytes``, ``n_removed``, ``n_spans`` behind the columns in ``carry``.

    A character cut in two by a span loses its remaining bytes in ``kept``; with ``digests``, ``kept_sha256`` of the exact bytes takes its place.
    """
    carry = carry if carry is not None else ["doc_id"]
    spans = repeated_spans(docs, length)
    # the spans of one document meet here, each once however many rows repeat it: a bounded share of its own length
    collected = spans.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("s"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            inner, cut = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            rows = np.stack([inner.field(c).to_numpy() for c in ("start", "end")], axis=1) if len(inner) else np.zeros((0, 2), dtype=np.int64)
            packed = [merged(rows[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(packed, pa.binary())], ["_doc", "_doc_key", "_doc_spans"])

    per_row = materialize(collected.mapInArrow(tidy(pack), "_doc long, _doc_key long, _doc_spans binary"), "spans")
    joined = join_small(_own_names(docs, carry), per_row, ["_doc", "_doc_key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _texts(batch):
                out = []
                for i, _, _, raw in run:
                    runs = np.frombuffer(batch.column("_doc_spans")[i].as_py() or b"", dtype=np.int64).reshape(-1, 2).tolist()
                    edges = [0, *[e for r in runs for e in r], len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    removed = len(raw) - len(kept)
                    shown = hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "ignore")
                    out.append((len(raw), removed, len(runs), shown))
                columns = [batch.column(c).slice(run[0][0], len(run)) for c in carry]
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*carry, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"])

    fields = with_fields(docs, carry, f"n_bytes long, n_removed long, n_spans long, {'kept_sha256' if digests else 'kept'} string")
    return joined.select(*carry, "_doc", "_doc_key", "_doc_text", "_doc_spans").mapInArrow(tidy(cut), fields)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)


QUERIES = {"op5_repeats": op5_repeats}
ORACLE: dict[str, str] = {}
