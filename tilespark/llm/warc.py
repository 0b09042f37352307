"""WARC archives in seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames of whole WARC records, a skippable frame that maps record identifiers to
(frame, offset inside the frame's plain bytes, length), and a footer seek table in the seekable format, itself a skippable frame, so that any
Zstandard reader reads the file from front to back and a reader that knows the table fetches one record by reading one frame.

Bundles are written by Spark's own committer, one file for each row: the row is the bundle without its last four bytes, which are a
constant, and those are the text writer's line separator. No executor opens a file by itself, and retried tasks leave no halves.

Payload deduplication: of records with equal payloads of at least ``least`` bytes that with the smallest page_id is a response and the others
revisit it. Groups are found by digest with partial aggregation (a group's size never reaches one task), and the roles are joined
back by digest, a shuffle join that adaptive execution splits where a digest is hot.

Defined cases: null html is an empty payload; null url writes no target; rows that repeat the smallest page_id with the same payload are
all responses; a row without page_id is never referred to, but may revisit; an empty table gives no bundles and an empty result; other columns are
ignored, whatever their names. A record larger than a frame or bundle gets one of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm.shared import bounded_batches, new_path

#: Fixed values of the Zstandard formats.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FOOTER = struct.pack("<I", SEEKABLE_MAGIC)
#: Fixed value of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Plain bytes of a frame, compressed bytes of a bundle, about.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20

RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    value = urn.strip()[len("<urn:page:") : -1]
    return None if value == "none" else int(value)


def encode_record(page_id, url, payload, n, digest, kind, refers_to, date="2024-01-01T00:00:00Z") -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """Headers (lower-case names) and ``payload`` of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields | {"payload": rest[:n]}


class BundleWriter:
    """Collects records; :meth:`close` returns the bundle's bytes."""

    def __init__(self, level: int = 3):
        self.level, self.frames, self.index, self.size = level, [], [], 0
        self._open: list[bytes] = []
        self._open_bytes = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self._open and self._open_bytes + len(record) > FRAME_BYTES:
            self._end_frame()
        self.index.append((page_id, len(self.frames), self._open_bytes, len(record)))
        self._open.append(record)
        self._open_bytes += len(record)

    def _end_frame(self) -> None:
        frame = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(b"".join(self._open))
        self.frames.append((frame, self._open_bytes))
        self.size += len(frame)
        self._open, self._open_bytes = [], 0

    def close(self) -> bytes:
        if self._open:
            self._end_frame()
        entries = b"".join(struct.pack("<?qIII", p is not None, p or 0, f, o, n) for p, f, o, n in self.index)
        packed = zstandard.ZstdCompressor(level=self.level).compress(entries)
        index = struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed
        table = [struct.pack("<II", len(f), n) for f, n in self.frames] + [struct.pack("<II", len(index), 0)]
        seek = b"".join(table) + struct.pack("<IB", len(table), 0) + FOOTER
        return b"".join(f for f, _ in self.frames) + index + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek


class BundleReader:
    """Random access to a bundle through ``read_at(offset, length)`` and its size; reads the footer, then only what is asked for."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        n, _, magic = struct.unpack("<IBI", read_at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        table = read_at(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        start, packed, _ = self.frames.pop()  # the record index
        raw = read_at(start, packed)
        magic, length = struct.unpack_from("<II", raw)
        if magic != SKIPPABLE_INDEX or length != packed - 8:
            raise ValueError("no record index")
        entries = zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=1 << 31)
        self.index = [(p if known else None, f, o, n) for known, p, f, o, n in struct.iter_unpack("<?qIII", entries)]

    def frame(self, i: int) -> bytes:
        start, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.read_at(start, packed), max_output_size=max(plain, 1))

    def record(self, page_id: int | None) -> dict:
        for p, f, o, n in self.index:
            if p == page_id:
                return decode_record(self.frame(f)[o : o + n])
        raise KeyError(page_id)

    def records(self) -> Iterator[dict]:
        open_frame, plain = None, b""
        for _, f, o, n in self.index:
            if f != open_frame:
                open_frame, plain = f, self.frame(f)
            yield decode_record(plain[o : o + n])


def records_of(pages: DataFrame, least: int = 100) -> DataFrame:
    """The records to write, with payload, digest and role."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    shared = (
        own.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"))
    )
    joined = own.join(shared, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= least), "left")
    again = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    return joined.select(
        *own.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = lambda b: pa.RecordBatch.from_arrays([pa.array([b[: -len(FOOTER)]], pa.binary())], ["bundle"])
    writer = BundleWriter()
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")]
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in columns]
            writer.add(row[0], encode_record(*row))
            if writer.size >= BUNDLE_BYTES:
                yield out(writer.close())
                writer = BundleWriter()
    if writer.index:
        yield out(writer.close())


def write_archive(records: DataFrame, path: str) -> None:
    """Write bundles below ``path``, one file each."""
    bounded_batches(records.sparkSession)
    bundles = records.mapInArrow(_bundles, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    # the separator behind a row is the footer's magic number, taken byte by byte
    bundles.write.option("lineSep", FOOTER.decode("iso-8859-1")).option("encoding", "iso-8859-1").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: identifiers, role, payload (null for revisits), declared and, for responses, checked digest and length."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                if not raw.size:  # a task without records
                    continue
                view = memoryview(raw)
                rows: list[tuple] = []
                held = 0
                for r in BundleReader(lambda o, n, v=view: bytes(v[o : o + n]), raw.size).records():
                    digest, n = r["warc-payload-digest"].removeprefix("sha256:"), int(r["x-payload-length"])
                    revisit = r["warc-type"] == "revisit"
                    if not revisit and (len(r["payload"]) != n or hashlib.sha256(r["payload"]).hexdigest() != digest):
                        raise ValueError(f"{r['warc-record-id']}: the payload is not what was written")
                    rows.append((_from_urn(r["warc-record-id"]), r.get("warc-target-uri"), None if revisit else r["payload"], n, digest, r["warc-type"], _from_urn(r["warc-refers-to"]) if revisit else None))
                    held += len(r["payload"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(records_of(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM f
"""

QUERIES = {"op2_warc": op2_warc}
ORACLE = {"op2_warc": OP2_SQL}
