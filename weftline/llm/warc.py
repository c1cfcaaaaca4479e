"""Conversion of legacy ARC archives to WARC, with a writer and a reader for both ends.

An ARC file is a run of records: a header line whose fields depend on the
version that the file's first record names, then as many bytes as the line
declares.  The converter parses these lines and lengths and synthesises what a
WARC record has beyond them: an identifier, an ISO timestamp, a type and
digests.  WARC files are runs of gzip members, one a record.

Files go to the shared folder: a task writes to a name of its own and renames
it, so a task that runs again leaves one complete file.  They are read back by
Spark's reader of whole files, which are kept small.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, batch_rows

#: Compressed bytes after which a task begins another archive.
FILE_BYTES = 4 << 20
#: Compressed bytes handed to the decompressor at once.
_PIECE = 1 << 14

# Header fields of the two versions of the ARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_ARC_LINE = {
    1: re.compile(r"(?P<url>.*?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.*?) (?P<length>\d+)", re.S),
    2: re.compile(r"(?P<url>.*?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.*?) (?P<code>\d+|-) (?P<sum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)", re.S),
}


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str  # 14 digits
    content_type: str
    body: bytes
    offset: int  # of the header line in the file
    truncated: bool = False


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_url(url: str | None) -> str:
    """A URL as an ARC header can hold it: white space and control characters escaped, `-` for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def write_arc(version: int, name: str, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of records (url, ip, 14-digit date, content type, body)."""
    about = f"{version} 0 weftline\n{ARC_FIELDS[version]}\n\n".encode()
    out = io.BytesIO()
    extra = f"200 - - 0 {name} " if version == 2 else ""
    out.write(f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {extra}{len(about)}\n".encode() + about)
    for url, ip, date, kind, body in records:
        more = f"200 {sha1_base32(body)} - {out.tell()} {name} " if version == 2 else ""
        out.write(f"\n{arc_url(url)} {ip} {date} {kind} {more}{len(body)}\n".encode() + body)
    out.write(b"\n")
    return out.getvalue()


def read_arc(data: bytes | BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file or stream; the first describes the file.  A body shorter than declared is marked."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    begin, version = 0, 0
    while whole := stream.readline():
        line = whole.lstrip(b"\r\n")
        at, begin = begin + len(whole) - len(line), begin + len(whole)
        if not line:
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not version:
            declared = text.rpartition(" ")[2]
            if not text.startswith("filedesc://") or not declared.isdigit():
                raise ValueError("an ARC file begins with a filedesc record")
            body = stream.read(int(declared))
            first = body.split(None, 1)
            version = int(first[0]) if first and first[0] in (b"1", b"2") else 1
            fields = _ARC_LINE[version].fullmatch(text) or _ARC_LINE[1].fullmatch(text)
        else:
            fields = _ARC_LINE[version].fullmatch(text)
            body = stream.read(int(fields["length"])) if fields else b""
        if not fields:
            raise ValueError(f"no ARC version {version} header at byte {at}: {text[:200]!r}")
        begin += len(body)
        yield ArcRecord(version, fields["url"], fields["ip"], fields["date"].ljust(14, "0"), fields["type"], body, at, len(body) < int(fields["length"]))


def split_http(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (lower-cased names) and payload of an HTTP response, None for other blocks."""
    if not block.startswith(b"HTTP/"):
        return None
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("utf-8", "surrogateescape").splitlines()[1:]
    pairs = (x.partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, payload


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def convert(arc: ArcRecord, source: str, *, identity: str | None = None, refers_to: str | None = None) -> WarcRecord:
    """The WARC record of an ARC record; as a revisit of the record named, if one is."""
    d = arc.date
    headers = {
        "WARC-Type": "resource",
        "WARC-Record-ID": record_id(identity or f"{source}#{arc.offset}"),
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Target-URI": arc.url,
        "WARC-IP-Address": arc.ip,
    }
    block, kind = arc.body, arc.content_type
    http = split_http(block)
    if arc.url.startswith("filedesc://"):
        headers["WARC-Type"] = "warcinfo"
        headers["WARC-Filename"] = headers.pop("WARC-Target-URI").removeprefix("filedesc://")
        del headers["WARC-IP-Address"]
    elif http is not None:
        headers["WARC-Type"], kind = "response", "application/http; msgtype=response"
        headers["WARC-Payload-Digest"] = "sha1:" + sha1_base32(http[1])
        if refers_to:
            headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": refers_to}
            block = block[: len(block) - len(http[1])]
    elif arc.url.startswith("dns:"):
        headers["WARC-Type"], kind = "response", "text/dns"
    if arc.truncated:
        headers["WARC-Truncated"] = "length"
    headers |= {"WARC-Block-Digest": "sha1:" + sha1_base32(block), "Content-Type": kind, "Content-Length": str(len(block))}
    return WarcRecord(headers, block)


def warc_bytes(record: WarcRecord, level: int = 5) -> bytes:
    """One gzip member."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogateescape") + record.block + b"\r\n\r\n") + z.flush()


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members one after another; the input is handed over in pieces, so that time is linear in it."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + _PIECE]
            if not piece:
                raise ValueError("the last gzip member is cut off")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of a WARC file of gzip members; declared lengths and block digests are checked."""
    for raw in _members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = rest[: int(headers["Content-Length"])]
        digest = "sha1:" + sha1_base32(block)
        if len(rest) != len(block) + 4 or headers.get("WARC-Block-Digest", digest) != digest:
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield WarcRecord(headers, block)


def _http(page_id: object, payload: bytes) -> bytes:
    about = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{about}\r\n".encode() + payload


class _Archives:
    """WARC files of about `file_bytes` in `folder`; each appears under its name only when it is complete."""

    def __init__(self, folder: str, label: str, file_bytes: int):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        task = TaskContext.get()
        self.attempt = task.taskAttemptId() if task else 0
        self.label, self.file_bytes = label, file_bytes
        self.done: list[tuple[str, int, int]] = []  # name, records, bytes
        self.held: list[bytes] = []
        self.size = 0

    def add(self, record: WarcRecord) -> None:
        self.held.append(warc_bytes(record))
        self.size += len(self.held[-1])
        if self.size > self.file_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            name = f"{self.root}/{self.label}-{len(self.done):05d}.warc.gz"
            with self.store.open_output_stream(f"{name}.{self.attempt}.tmp") as f:
                f.write(b"".join(self.held))
            self.store.move(f"{name}.{self.attempt}.tmp", name)
            self.done.append((name, len(self.held), self.size))
        self.held, self.size = [], 0


def _converting(folder: str, date: str, file_bytes: int):
    """Pages to ARC files in memory (both versions in turn), these through the converter, the records to WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        archives = _Archives(folder, f"part-{part:06d}", file_bytes)
        for turn, batch in enumerate(batches, 1):
            rows = batch.to_pylist()
            source = f"part-{part:06d}-{turn:06d}.arc"
            arc = write_arc(1 + turn % 2, source, [(r["url"], "0.0.0.0", date, "text/html", _http(r["page_id"], r["payload"])) for r in rows])
            for k, record in enumerate(read_arc(arc)):
                r = rows[k - 1] if k else None
                identity, refers = f"{folder}/{source}#{record.offset}", None
                if r and r["page_id"] is not None:
                    if r["keeper"] is not None and r["keeper"] != r["page_id"]:
                        refers = record_id(f"{r['digest']}/{r['keeper']}")
                    else:
                        identity = f"{r['digest']}/{r['page_id']}"
                elif r and r["keeper"] is not None:
                    refers = record_id(f"{r['digest']}/{r['keeper']}")
                archives.add(convert(record, source, identity=identity, refers_to=refers))
        archives.flush()
        columns = list(zip(*archives.done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "records", "bytes"])

    return run


_CONVERTED = "source string, file string, records long, bytes long, error string"


def _converting_files(folder: str, file_bytes: int):
    """Rows of (path, content) of ARC files, plain or of gzip members, to WARC files and their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archives = _Archives(folder, f"{path.rpartition('/')[2]}-{hashlib.sha1(path.encode()).hexdigest()[:12]}", file_bytes)
                stream = io.BufferedReader(pa.BufferReader(content.as_buffer()))
                error = None
                try:
                    packed = content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b"
                    for record in read_arc(gzip.GzipFile(fileobj=stream) if packed else stream):
                        archives.add(convert(record, path))
                except (ValueError, EOFError, OSError, zlib.error) as wrong:
                    error = str(wrong).encode("utf-8", "replace").decode()
                archives.flush()
                made += [(path, *row, None) for row in archives.done]
                if error is not None:
                    made.append((path, None, 0, 0, error))
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _CONVERTED.split(", ")])

    return run


def convert_arc_folder(spark: SparkSession, source: str, folder: str, *, glob: str = "*.{arc,arc.gz}", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Converts all ARC files below `source`, plain or gzip, to WARC files in `folder`; (source, file, records, bytes, error).

    A row is a file written; a file that is damaged has what stands before the damage converted and one more row, without
    a file, that says what is wrong.  A last body shorter than declared is kept and marked as truncated; empty files give
    no row.  Files of one name in different folders stay apart, and running again writes the same names and identifiers.
    Files are read whole, so one may have up to 2 GB.
    """
    scratch = Scratch(spark, "arc")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source).select("path", "content")
    with batch_rows(spark, 1):  # rows are whole files here
        return scratch.save(files.mapInArrow(_converting_files(folder, file_bytes), _CONVERTED), "manifest")


_READ = "page_id string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_record string, url string, date string"


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            rows = []
            for record in read_warc(batch.column(0)[k].as_py()):
                h = record.headers
                if h["WARC-Type"] not in ("response", "revisit"):
                    continue
                http, payload = split_http(record.block) or ({}, record.block)
                full = h["WARC-Type"] == "response"
                found = sha1_base32(payload) if full else None
                digest = h.get("WARC-Payload-Digest", f"sha1:{found}").removeprefix("sha1:")
                if full and digest != found:
                    raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
                n = len(payload) if full else int(http.get("content-length", 0))
                rows.append((http.get("x-page-id"), n, digest, h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"].encode("utf-8", "replace").decode(), h["WARC-Date"]))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, cols, strict=True)], names)


def archive_pages(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "20240101000000", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a WARC record for each page to `folder`, by way of ARC records; a table of the files written.

    Of pages with equal payloads of `min_revisit_bytes` or more, the one with the largest id is the response and the
    others revisit it.  Null payloads are empty.  Rows that repeat the largest id are all responses, of one identifier;
    rows without an id are revisits if another row of their payload has one, else responses.  Columns beyond the three
    are ignored, whatever their names.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    joined = rows.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", "keeper")
    return joined.mapInArrow(_converting(folder, date, file_bytes), "file string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id as text, payload_bytes, payload_digest, record_type, record_id, refers_to_record, url, date) of the responses and revisits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(_reading, _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    kind = pages.schema[options.get("page_id", "page_id")].dataType
    folder = f"{scratch.path}/archives"
    written = scratch.save(archive_pages(pages, folder, **options), "manifest").agg(F.sum("records")).first()[0]
    with batch_rows(spark, 2):  # rows are whole files here
        records = scratch.save(read_archives(spark, folder).withColumn("page_id", F.col("page_id").cast(kind)), "records") if written else None
    scratch.drop("archives", "manifest")
    if records is None:
        return spark.createDataFrame([], f"page_id {kind.simpleString()}, payload_bytes long, payload_digest string, record_type string, refers_to {kind.simpleString()}")
    wanted = records.select(F.col("refers_to_record").alias("record_id")).distinct()
    targets = records.where("record_type = 'response'").join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("page_id").alias("refers_to"))
    return records.join(targets, "refers_to_record", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
