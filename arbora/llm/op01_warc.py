"""WARC archives: a writer and a splittable reader.

Writing. Every row becomes one WARC/1.1 record in a gzip member of its own, behind
a warcinfo record that each file begins with and the reader leaves out. Of
records with equal payloads (by SHA-1, from ``min_revisit_bytes`` on) the one
with the smallest page_id is a response and the others are revisits that refer
to it. Spark's text writer commits the members, so a lost or repeated task
leaves no half archive behind. That writer ends each row with a separator; a
member's last byte, the high byte of its length, is 0 for records under 16 MiB,
so it is left to the separator, itself one 0 byte. Longer records get their own
last byte and the 0 after it is padding, which gzip readers skip.

Reading. A task takes a byte range of a file. It looks for the gzip magic,
validates each candidate by decoding its headers (a version line, a type and a
length), and owns the members that start inside its range, however far they reach. Members
are decoded as a stream; the checksum at their end is verified.

Defined results: a null payload is empty; records with a null page_id are
revisits of any smaller id and otherwise responses; rows that repeat the
smallest page_id of a payload are all responses; an empty table gives an empty
archive; extra columns are not archived. A damaged member stops the reader with
an error instead of losing records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import new_path, table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
#: Bytes read from a file at a time.
BLOCK = 1 << 20
#: Bytes that a record's headers have at most; a candidate is decoded until they end.
HEADERS = 1 << 20
_URN = "urn:arbora:page:"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string, offset long"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def assign_types(pages: DataFrame, payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to): which record repeats which.

    Groups are pre-aggregated to their smallest id before they meet the rows,
    and only groups of two or more are kept; Spark splits the join where a
    payload is hot.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", raw.alias("payload")).withColumn("sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= min_revisit_bytes
    groups = rows.where(large).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(groups.where("n > 1").drop("n"), "sha1", "left").drop("sha1")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & large
    return rows.select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _member(page_id, url, payload: bytes, record_type: str, refers_to, date: str) -> bytes:
    """One record as a gzip member, without the last byte where that is 0."""
    digest = _digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if record_type == "response":
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = http + b"\r\n"
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        plain = "".join(c if 32 < ord(c) < 127 and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {plain}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()
    return out[:-1] if out[-1] == 0 else out


def _info(date: str) -> bytes:
    """The record that describes a file, as a gzip member without the last byte, 0."""
    block = b"software: arbora\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:arbora:info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush())[:-1]


def write_archive(pages: DataFrame, path: str, payload: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, payload column) as WARC files under ``path``."""
    date = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        first = True
        for batch in batches:
            for i in range(batch.num_rows):
                if first:
                    first = False
                    yield pa.RecordBatch.from_arrays([pa.array([_info(date)], pa.binary())], ["member"])
                row = [batch.column(k)[i].as_py() for k in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array([_member(row[0], row[1], row[2] or b"", row[3], row[4], date)], pa.binary())], ["member"])

    members = assign_types(pages, payload, min_revisit_bytes).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", "\x00").text(path)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("/"):
        path = f"file://{path}"
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


class _Blocks:
    """Bytes of a file from an offset on, read in blocks and dropped behind the cursor."""

    def __init__(self, file, offset: int):
        self.file, self.start, self.data = file, offset, b""

    def more(self) -> bool:
        self.file.seek(self.start + len(self.data))
        got = self.file.read(BLOCK)
        self.data += got
        return bool(got)

    def upto(self, offset: int) -> None:
        self.data, self.start = self.data[offset - self.start:], offset

    def find(self, end: int) -> int | None:
        """The next offset of the magic before ``end``; the cursor moves there."""
        while True:
            at = self.data.find(MAGIC)
            if at >= 0:
                self.upto(self.start + at)
                return self.start if self.start < end else None
            self.upto(self.start + max(0, len(self.data) - len(MAGIC) + 1))
            if self.start >= end or not self.more():
                return None


def _headers(text: bytes) -> dict[str, str]:
    """Headers of a record (lower-case names) from its version line to the empty line."""
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _is_record(blocks: _Blocks) -> bool:
    """Whether the bytes at the cursor begin a gzip member that holds a record: its headers are decoded."""
    unpack, text, used = zlib.decompressobj(31), b"", 0
    try:
        while b"\r\n\r\n" not in text and len(text) < HEADERS and not unpack.eof:
            if used == len(blocks.data) and not blocks.more():
                break
            # A little at a time: most candidates fail at once, and headers are short.
            text += unpack.decompress(blocks.data[used:used + 1024])
            used = min(len(blocks.data), used + 1024)
            if text and not text.startswith(VERSION[:len(text)]):
                return False
    except zlib.error:
        return False
    head, end, _ = text.partition(b"\r\n\r\n")
    if not end or not re.match(rb"WARC/\d+\.\d+\r\n", head):
        # A member that is cut off may still be a record, which the reader then reports.
        return not end and not unpack.eof and text.startswith(VERSION) and len(text) < HEADERS
    fields = _headers(head)
    return "warc-type" in fields and fields.get("content-length", "").isdigit()


def members(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members with records that start in [start, end)."""
    with _open(path) as file:
        blocks = _Blocks(file, start)
        while (at := blocks.find(end)) is not None:
            if not _is_record(blocks):
                blocks.upto(at + 1)
                continue
            unpack, parts, used = zlib.decompressobj(31), [], 0
            while True:
                parts.append(unpack.decompress(blocks.data[used:]))
                if unpack.eof:
                    blocks.upto(blocks.start + len(blocks.data) - len(unpack.unused_data))
                    break
                blocks.upto(blocks.start + len(blocks.data))
                if not blocks.more():
                    raise ValueError(f"{path}: the member at {at} has no end")
            yield at, b"".join(parts)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record in a member."""
    at = 0
    while content.startswith(VERSION, at):
        stop = content.index(b"\r\n\r\n", at)
        head = _headers(content[at:stop])
        size = int(head["content-length"])
        block = content[stop + 4: stop + 4 + size]
        if len(block) != size:
            raise ValueError("a record is shorter than its Content-Length")
        yield head, block
        at = stop + 4 + size + 4


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archive(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Records of the gzip WARC files under ``path``, read in ranges of ``split_bytes``."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {int(split_bytes)}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    n = max(1, int(ranges.count()))
    # By order and not by hash, so that every task gets about one range.
    ranges = ranges.repartitionByRange(n, "path", "start")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in _RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        for batch in batches:
            for one in batch.to_pylist():
                for offset, content in members(one["path"], one["start"], one["stop"]):
                    for head, block in _records(content):
                        kind, payload = head.get("warc-type"), None
                        if kind == "warcinfo":
                            continue
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                        digest = _digest(payload) if payload is not None else head.get("warc-payload-digest", "").removeprefix("sha1:")
                        size = len(payload) if payload is not None else int(head.get("x-payload-length", -1))
                        row = [_page(head.get("warc-record-id")), head.get("warc-target-uri"), kind, _page(head.get("warc-refers-to")), digest, size, payload, one["path"], offset]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    return ranges.mapInArrow(run, _RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
