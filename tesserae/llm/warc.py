"""Legacy archive conversion: ARC files to WARC records, deduplicated, written and read back.

ARC. A file begins with a version block whose second and third lines give the version and the names
of the header fields; version 1 has five, version 2 has ten. Every record has one header line, a body
of the length that its last field declares, and a line end. Lengths alone delimit bodies.

WARC. From each record an identifier, a timestamp, a type and digests are synthesised: HTTP answers
become ``response``, DNS and other answers ``resource``, version blocks ``warcinfo``. Identifiers are
named by archive, place in it and content, so they are unique, and reruns over the same splits agree.
Of records with equal payloads of at least ``LEAST`` bytes all but the one with the largest key become
``revisit``, which hold the HTTP header without the payload and refer to that record.

Pages are written as ARC records, one for each row whatever its URL: white space in it, and the first
letter of one that would begin like a version block, are percent-encoded. The converted records are
written as a table once, so what is a revisit is decided on its slim columns.

Files are written by Spark's text sink, gzipped, with the blank lines that end a WARC record as the
line separator; its commit protocol makes a lost executor harmless. A file holds what a split of the
records holds, or ``FILE_BYTES`` of payload on average where records are dealt out. Reading goes by declared
lengths, never by separators, from the compressed bytes of one file, one record at a time.

A null payload is empty, a null URL is ``http://unknown.invalid/``, and a null key is written as no
key: such a record is always a response. Rows that repeat a key are records of their own, and are all
responses if the key is the largest of its payload. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST, BROADCAST_ROWS, ARC_BYTES, FILE_BYTES, ROWS = 1000, 50_000, 4_000_000, 256_000_000, 5_000
#: Header fields of the two ARC versions (fixed values of the format).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
END = "\r\n\r\n"
DATE = "20240101000000"
KEY = b"X-Archive-Key"


# --- ARC ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    place: str = ""  # name of the archive and offset in it


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file, the version block first. Raises ValueError where it is broken."""
    at, fields, name = 0, FIELDS[1].split(), ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        first = line.startswith("filedesc://")
        parts = line.rsplit(" ", len(FIELDS[1].split()) - 1 if first else len(fields) - 1)  # a URL may hold spaces
        names = FIELDS[1].split() if first else fields
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header at byte {at}: {line[:80]!r}")
        row, size = dict(zip(names, parts, strict=True)), int(parts[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"the record at byte {at} declares {size} bytes, {len(body)} are left")
        if first:
            name = row["URL"]
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            fields = lines[1].split() if len(lines) > 1 and lines[1].startswith("URL ") else FIELDS[version].split()
        yield ArcRecord(row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], body, f"{name}#{at}")
        at = end + 1 + size


def make_arc(records: Iterator[tuple[str, bytes]], version: int = 1, date: str = DATE, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, HTTP answer) pairs."""
    head = f"{version} 0 tesserae\n{FIELDS[version]}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {len(head)}\n".encode(), head, b"\n"]
    for url, body in records:
        more = "" if version == 1 else f"200 - - 0 {name} "
        out += [f"{url} 0.0.0.0 {date} text/html {more}{len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def http_answer(payload: bytes, key: int | None = None) -> bytes:
    named = b"" if key is None else KEY + b": " + str(key).encode() + b"\r\n"
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + b"Content-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload


# --- WARC ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class WarcRecord:
    record_id: str
    kind: str
    url: str
    date: str
    content_type: str
    head: bytes  # the HTTP header with its blank line; empty where there is none
    payload: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha1(self.payload).digest()

    @property
    def key(self) -> int | None:
        m = re.search(rb"(?mi)^" + KEY + rb": (-?\d+)\r?$", self.head)
        return int(m[1]) if m else None


def iso_date(date: str) -> str:
    """The WARC timestamp of an ARC date of 4 to 14 digits; what is left out is the earliest."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def to_warc(arc: ArcRecord) -> WarcRecord:
    """The WARC equivalent of an ARC record."""
    date = iso_date(arc.date)
    head, payload, kind, content = b"", arc.body, "resource", arc.content_type or "application/octet-stream"
    if arc.url.startswith("filedesc://"):
        kind, content = "warcinfo", "application/warc-fields"
        payload = f"software: tesserae\r\nformat: WARC/1.1\r\ndescription: converted from {arc.url[11:]}\r\n".encode()
    elif arc.body.startswith(b"HTTP/"):
        kind, content = "response", "application/http; msgtype=response"
        m = re.search(rb"\r?\n\r?\n", arc.body)
        cut = m.end() if m else len(arc.body)
        head, payload = arc.body[:cut], arc.body[cut:]
    elif arc.url.startswith("dns:"):
        content = "text/dns"
    return WarcRecord(record_id(f"{arc.place} {arc.url} {date} {hashlib.sha1(arc.body).hexdigest()}"), kind, arc.url, date, content, head, payload)


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(r: WarcRecord, refers: int | None = None, refers_id: str | None = None) -> bytes:
    """A record without the blank lines that end it; as a revisit of ``refers_id`` it leaves out its payload."""
    revisit = refers_id is not None
    block = r.head if revisit else r.head + r.payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else r.kind}",
        f"WARC-Record-ID: {r.record_id}",
        f"WARC-Date: {r.date}",
        f"WARC-Target-URI: {r.url}" if r.kind != "warcinfo" else "WARC-Filename: converted.warc.gz",
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {base32(r.digest)}",
        f"Content-Type: {r.content_type}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.insert(6, f"WARC-Refers-To: {refers_id}")
        lines.insert(7, f"X-Refers-To-Key: {refers}")
    return "\r\n".join(lines).encode() + END.encode() + block


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by declared length."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"a record declares {size} bytes, {len(block)} are left")
        if base32(hashlib.sha1(block).digest()) != fields.get("warc-block-digest", base32(hashlib.sha1(block).digest())):
            raise ValueError(f"the block of {fields.get('warc-record-id')} does not have its digest")
        yield fields, block


# --- DataFrames ---------------------------------------------------------------------------------

_RECORDS = "key long, record_id string, kind string, url string, date string, content_type string, digest binary, size long, head binary, payload binary"


def arc_url(url: str | None) -> str:
    """The URL of a page as it can stand in an ARC header line."""
    plain = re.sub(r"\s", "%20", url) if url else "http://unknown.invalid/"
    return f"%{ord(plain[0]):02x}{plain[1:]}" if plain.startswith("filedesc://") else plain


def _arcs(batches: Iterator[pa.RecordBatch], version: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, url, payload) to ARC files; the task's number and the file's make its name."""
    task = TaskContext.get().partitionId()
    for n, batch in enumerate(shared.slices(batches, 2, ARC_BYTES)):
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        plain = ((arc_url(u), http_answer((h or "").encode(), k)) for k, u, h in rows)
        yield pa.RecordBatch.from_arrays([pa.array([make_arc(plain, version, name=f"pages-{task:06d}-{n:06d}.arc")], pa.binary())], names=["arc"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ARC files to the WARC equivalents of their records."""
    for batch in batches:
        for data in batch.column(0):
            found = [to_warc(a) for a in parse_arc(data.as_py() or b"") if not a.url.startswith("filedesc://")]
            cols = [
                pa.array([r.key for r in found], pa.int64()),
                *(pa.array([getattr(r, n) for r in found], pa.string()) for n in ("record_id", "kind", "url", "date", "content_type")),
                pa.array([r.digest for r in found], pa.binary()),
                pa.array([len(r.payload) for r in found], pa.int64()),
                pa.array([r.head for r in found], pa.binary()),
                pa.array([r.payload for r in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "record_id", "kind", "url", "date", "content_type", "digest", "size", "head", "payload"])


def _slim(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    shared.small_batches(pages.sparkSession)
    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 1) -> DataFrame:
    """ARC files (column ``arc``) of about ``ARC_BYTES``, that hold the pages as HTTP answers."""
    return _slim(pages, key, url, payload).mapInArrow(lambda batches: _arcs(batches, version), "arc binary")


def records(arcs: DataFrame) -> DataFrame:
    """The WARC equivalents of the records in ARC files."""
    return arcs.select("arc").mapInArrow(_records, _RECORDS)


def pages_to_records(pages: DataFrame, version: int = 1, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``records(pages_to_arc(pages))`` in one step, so that an archive never leaves the task."""
    return _slim(pages, key, url, payload).mapInArrow(lambda batches: _records(_arcs(batches, version)), _RECORDS)


def revisits(described: DataFrame, least: int = LEAST) -> DataFrame:
    """(record_id, refers, refers_id) of each response whose payload of ``least`` bytes or more has a larger key."""
    large = described.where((F.col("size") >= least) & (F.col("kind") == "response") & F.col("key").isNotNull())
    last = F.max(F.struct("key", "record_id")).alias("last")
    groups = large.groupBy("digest", "size").agg(last, F.count("*").alias("n")).where("n > 1")
    named = shared.stored(groups.select("digest", "size", F.col("last.key").alias("refers"), F.col("last.record_id").alias("refers_id")), "payloads")
    met = large.select("key", "record_id", "digest", "size").join(shared.small(named, named.count()), ["digest", "size"])
    return met.where("key < refers").select("record_id", "refers", "refers_id")


def write_warc(whole: DataFrame, decisions: DataFrame, path: str) -> None:
    """Write gzipped WARC files; each begins with a warcinfo record.

    The decisions are broadcast only if there are few of them, which is counted; otherwise the
    records are dealt out by their identifiers, in as many parts as their sizes need, and joined.
    """
    if decisions.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = whole.join(F.broadcast(decisions), "record_id", "left")
    else:
        total = whole.agg(F.sum("size")).first()[0] or 0
        parts = 1 + total // FILE_BYTES
        joined = whole.repartition(parts, "record_id").join(decisions.repartition(parts, "record_id"), "record_id", "left")
    cols = ["key", "record_id", "kind", "url", "date", "content_type", "head", "payload", "refers", "refers_id"]

    def run(batches):
        first = True
        for batch in shared.slices(batches, 7):
            out = []
            for r in batch.to_pylist():
                w = WarcRecord(r["record_id"], r["kind"], r["url"], r["date"], r["content_type"], r["head"], r["payload"])
                if first:
                    out.append(record_bytes(to_warc(ArcRecord("filedesc://converted", "0.0.0.0", DATE, "text/plain", b"", w.record_id))))
                    first = False
                out.append(record_bytes(w, r["refers"], r["refers_id"]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = joined.select(*cols).mapInArrow(run, "value binary")
    as_text = made.select(F.col("value").cast("string").alias("value"))  # bytes stay as they are
    as_text.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per response or revisit: key, payload_bytes, payload_digest (hex), record_type, refers_to."""

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def give(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in parse_warc(gzip.GzipFile(fileobj=pa.BufferReader(data.as_buffer()))):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    m = re.search(rb"\r?\n\r?\n", block)
                    head, payload = block[: m.end()], block[m.end() :]
                    told = base64.b32decode(fields["warc-payload-digest"][5:])
                    size = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", head)[1])
                    if kind == "response" and (hashlib.sha1(payload).digest() != told or len(payload) != size):
                        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its header says")
                    key = re.search(rb"(?mi)^" + KEY + rb": (-?\d+)\r?$", head)
                    refers = fields.get("x-refers-to-key")
                    rows.append((int(key[1]) if key else None, size, told.hex(), kind, int(refers) if refers else None))
                    if len(rows) == ROWS:
                        yield give(rows)
                        rows = []
                yield give(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def convert(pages: DataFrame, path: str, version: int = 1, least: int = LEAST) -> DataFrame:
    """Pages to ARC to deduplicated WARC files under ``path``, and what reading those gives."""
    spark = pages.sparkSession
    made = shared.stored(pages_to_records(pages, version), "records", even=False)
    decisions = shared.stored(revisits(made.select("key", "record_id", "kind", "digest", "size"), least), "revisits")
    write_warc(made, decisions, path)
    for table in (made, decisions):
        shared.dropped(spark, table)
    return read_warc(spark, path)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM {pages}
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to FROM g
"""
