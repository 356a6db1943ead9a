"""WARC archives as a PySpark data source, with deduplicated payloads.

Archives are gzip files with one member per record.  Each member carries its compressed length (the ``sl``
extra field), so that a reader can leave a record's payload compressed and go on to the next one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from emberlog.llm.common import table, work_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary, digest_ok boolean"
)
#: Columns that hold a header's value as it stands; filters on these are answered from headers alone.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE, SPLIT = 512 << 20, 64 << 20    # bytes of a file and of a read partition, about
_OUT = 8 << 20                       # bytes of payload in one Arrow batch
_MANIFEST = "manifest-"
_END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(record: bytes) -> bytes:
    """A gzip member with its own length in the ``sl`` field: compressed, and without compression."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<H", 8) + struct.pack("<II", total if total < 1 << 32 else 0, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _header_value(text: str) -> str:
    """A value without control characters, which would end the header."""
    return "".join(urllib.parse.quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in text)


def _record(row: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}".encode() + _END
    block = http if row["record_type"] == "revisit" else http + (row["payload"] or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date'] or DATE}",
        f"WARC-Payload-Digest: {row['payload_digest']}", "Content-Type: application/http;msgtype=response",
    ]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_header_value(row['target_uri'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block + _END


@dataclass
class Files(WriterCommitMessage):
    spans: list


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path; any that pyarrow knows."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own names; the commit lists the files of the tasks that succeeded, and only those are read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        spans, out, at, begin, name = [], None, 0, 0, ""

        def close():
            if at > begin:
                spans.append([name, begin, at])
            out.close()

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, at, begin = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                member = _member(_record(row))
                out.write(member)
                at += len(member)
                if at - begin >= SPLIT:
                    spans.append([name, begin, at])
                    begin = at
                if at >= FILE:
                    close()
                    out = None
        if out is not None:
            close()
        return Files(spans)

    def commit(self, messages: list) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.jsonl", compression=None) as out:
            for message in messages:
                for span in message.spans if message else []:
                    out.write(json.dumps(span).encode() + b"\n")

    def abort(self, messages: list) -> None:
        """Files without a commit are never read."""


@dataclass
class Span(InputPartition):
    file: str
    begin: int
    stop: int | None


class WarcReader(DataSourceReader):
    """Plans a partition per span of the manifests, or per file where there is no manifest."""

    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters: list[Filter]):
        """Equality and IN on header columns are answered while headers are read; the rest is Spark's."""
        for f in filters:
            path = getattr(f, "attribute", ())
            column = path[0] if len(path) == 1 else None
            if isinstance(f, EqualTo) and column in HEADERS:
                self.wanted.append((column, frozenset([f.value])))
            elif isinstance(f, In) and column in HEADERS:
                self.wanted.append((column, frozenset(f.value)))
            elif isinstance(f, IsNotNull) and column in HEADERS:
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self) -> list[Span]:
        store, root = _open(self.path)
        infos = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        manifests = [i.path for i in infos if i.base_name.startswith(_MANIFEST)]
        if not manifests:
            return [Span(i.path, 0, None) for i in infos if i.base_name.endswith((".warc", ".warc.gz"))] or [Span("", 0, 0)]
        spans = []
        for path in manifests:
            with store.open_input_stream(path, compression=None) as lines:
                spans += [Span(f"{root}/{name}", a, b) for name, a, b in map(json.loads, lines.read().splitlines())]
        return spans or [Span("", 0, 0)]

    def _fits(self, headers: dict) -> bool:
        for column, values in self.wanted:
            value = headers.get(HEADERS[column])
            if value is None or values is not None and value not in values:
                return False
        return True

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _open(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.file) as source:
            records = _gzip_records if partition.file.endswith(".gz") else _plain_records
            for headers, load in records(source, partition.begin, partition.stop, self._fits):
                rows.append(self._row(headers, load))
                held += 512 + len(rows[-1]["payload"] or b"")
                if held >= _OUT:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def _row(self, headers: dict, load) -> dict:
        row = {c: headers.get(h) for c, h in HEADERS.items()} | {"payload": None, "payload_bytes": None, "digest_ok": None}
        kind = row["record_type"]
        if kind == "revisit" or self.payload:
            block = load()
            is_http = (row["content_type"] or "").startswith("application/http")
            head, _, payload = block.partition(_END) if is_http else (b"", b"", block)
            lengths = [line for line in head.lower().split(b"\r\n") if line.startswith(b"content-length:")]
            row["payload_bytes"] = int(lengths[0].split(b":")[1]) if lengths else len(payload)
            if kind != "revisit":
                row |= {"payload": payload, "payload_bytes": len(payload)}
                if row["payload_digest"]:
                    row["digest_ok"] = row["payload_digest"] == "sha1:" + base32_sha1(payload)
        return row


ARROW = pa.schema([
    *[(c, pa.string()) for c in HEADERS], ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])


def _headers(text: bytes) -> dict:
    """Header names in lower case; a line that begins with a blank goes on with the one before."""
    out, name = {}, None
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Member:
    """A gzip member that is decompressed as far as it is asked for."""

    def __init__(self, source, at: int):
        self.source, self.at, self.known = source, at, 0
        source.seek(at)
        data = source.read(1 << 14)
        if data[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        skip = 10
        if data[3] & 4:
            length = struct.unpack("<H", data[10:12])[0]
            field, skip = data[12:12 + length], 12 + length
            if field[:2] == b"sl":
                self.known = struct.unpack("<I", field[4:8])[0]
        for flag in (8, 16):      # name and comment end with a zero byte
            if data[3] & flag:
                skip = data.index(b"\0", skip) + 1
        skip += 2 if data[3] & 2 else 0
        self.unpack, self.text, self.next = zlib.decompressobj(-15), bytearray(), at + len(data)
        self.text += self.unpack.decompress(data[skip:], 1 << 16)

    def _feed(self) -> None:
        chunk = self.unpack.unconsumed_tail
        if not chunk:
            self.source.seek(self.next)
            chunk = self.source.read(1 << 18)
            self.next += len(chunk)
            if not chunk:
                raise ValueError(f"member at byte {self.at} is cut off")
        self.text += self.unpack.decompress(chunk, 1 << 20)

    def headers(self) -> bytes:
        while _END not in self.text and not self.unpack.eof:
            self._feed()
        head, _, rest = bytes(self.text).partition(_END)
        self.text = bytearray(rest)
        return head

    def block(self, length: int) -> bytes:
        while len(self.text) < length and not self.unpack.eof:
            self._feed()
        return bytes(self.text[:length])

    def end(self) -> int:
        """Where the next member begins; without the ``sl`` field the rest has to be decompressed to know."""
        if self.known:
            return self.at + self.known
        while not self.unpack.eof:
            self.text.clear()
            self._feed()
        return self.next - len(self.unpack.unused_data) + 8


def _gzip_records(source, begin: int, stop: int | None, fits):
    """(headers, load) of each member whose headers fit; ``load`` decompresses the block."""
    at, stop = begin, source.size() if stop is None else stop
    while at < stop:
        member = _Member(source, at)
        headers = _headers(member.headers())
        if fits(headers):
            yield headers, lambda m=member, n=int(headers.get("content-length", 0)): m.block(n)
        at = member.end()


def _plain_records(source, begin: int, stop: int | None, fits):
    """The same for archives without compression: unwanted blocks are skipped by a seek."""
    at, stop = begin, source.size() if stop is None else stop
    while at < stop:
        source.seek(at)
        text = source.read(1 << 14)
        while _END not in text:
            more = source.read(1 << 16)
            if not more:
                if text.strip():
                    raise ValueError(f"record at byte {at} is cut off")
                return
            text += more
        split = text.index(_END)
        headers = _headers(text[:split])
        length = int(headers.get("content-length", 0))
        start = at + split + 4

        def load(start=start, length=length):
            source.seek(start)
            return source.read(length)

        if fits(headers):
            yield headers, load
        at = start + length + 4


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload`` (true) decides whether payloads are decoded at all."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("a WARC folder is only appended to; write to a new one")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known, and let its reader see filters (a session setting that Spark leaves off)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def records_of(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html), in the form that the ``warc`` format writes.

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest page_id is a response and the others
    revisit it; all other rows are responses.  Rows that repeat that page_id with the same payload, and rows with a null page_id,
    are responses too.  A null html is an empty payload.

    Payloads are compared by digest in narrow rows; (page_id, digest) then meets the payload, so that a payload
    that very many pages share is no hot key where payloads are shuffled.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html"))
    rows = rows.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    narrow = rows.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    revisits = narrow.join(firsts.select("digest", "first"), "digest").filter("page_id <> first").distinct()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("first").isNotNull()
    return rows.join(revisits, ["page_id", "digest"], "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(DATE).alias("date"), F.lit(None).cast("string").alias("content_type"),
        F.concat(F.lit("sha1:"), _base32(F.col("digest"))).alias("payload_digest"), F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_bytes", F.when(~again, F.col("payload")).alias("payload"), F.lit(None).cast("boolean").alias("digest_ok"))


def _base32(hex40):
    """Forty hex digits as thirty-two base-32 digits: five of one are four of the other."""
    parts = []
    for i in range(0, 40, 10):
        bits = F.conv(F.substring(hex40, i + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(_B32), (F.shiftright(bits, 35 - 5 * k) % 32 + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*parts)


def write(records: DataFrame, path: str) -> None:
    """Append records to the archives of a folder.  An empty frame leaves an empty manifest."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of a folder's archives.  Filters on header columns are checked before payloads are touched."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back: responses with their payloads, revisits from headers."""
    path = work_path(spark, "warc")
    write(records_of(table(spark, sf_dir, "pages")), path)
    responses = read(spark, path).filter(F.col("record_type") == "response")
    revisits = read(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return responses.unionByName(revisits).select(
        number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"),
        F.coalesce("digest_ok", F.lit(True)).alias("digest_ok"))
