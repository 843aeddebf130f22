"""Web pages as WARC archives, and a reader that salvages damaged ones.

An archive is a sequence of gzip members with one record each; bytes of value zero may stand
between members. Plain records may stand there too. The reader checks every record: the member
must unpack to its end, the version line and the header must be well formed, the block must have
the length and the digest that the header says. Where a check fails it searches the next place
that looks like a member or a version line, tries it in the same way, and goes on from the first
that passes; the bytes between are reported as a gap with the reason. So damage costs the records
it touches and no others. An archive is one value of a row here, read whole by one task; the
writer keeps archives small (`RECORDS` records), and Spark ends a job that meets one of 2 GB.

Cases: a NULL html has an empty payload. A NULL url is replaced by the page's urn. Records with a
NULL page_id take part; of equal payloads the largest page_id is the response, NULL counts as
smallest. Rows with that same id are all responses. An empty table gives an empty archive folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.llm.store import again
from weblens.session import shared_folder

#: Records per archive, at most.
RECORDS = 2000
#: Payloads smaller than this are never made revisits.
LEAST_SHARED = 0
DATE = "2024-01-01T00:00:00Z"
_VERSION = b"WARC/1.1"
_MEMBER = b"\x1f\x8b\x08"
_PAD = "\x00"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_END = b"\r\n\r\n"
_ZEROS = re.compile(rb"\0*")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record of a page, or with `refers_to` a revisit record, as a gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        lines.insert(4, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        lines.insert(5, ("WARC-Refers-To", _urn(refers_to)))
    head = _VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + _END) + packer.flush()


class Damaged(ValueError):
    """A record did not pass a check."""


@dataclass
class Record:
    """A record that passed all checks, and where it stands in its archive."""

    headers: dict[str, str]
    block: bytes
    start: int
    stop: int
    payload: bytes = field(init=False)

    def __post_init__(self) -> None:
        cut = self.block.find(b"\r\n\r\n") if self.headers.get("content-type", "").startswith("application/http") else -4
        self.payload = self.block[cut + 4:] if cut != -1 else b""


def _parse(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record that begins at `start`, every check passed."""
    if not _VERSION_LINE.match(data, start):
        raise Damaged("no version line")
    end = data.find(_END, start)
    if end < 0:
        raise Damaged("the header does not end")
    headers: dict[str, str] = {}
    for line in data[start:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line has no colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Damaged("no content length")
    body = end + len(_END)
    block = data[body:body + int(length)]
    stop = body + int(length) + len(_END)
    if len(block) < int(length) or data[stop - len(_END):stop] != _END:
        raise Damaged("the block does not have its length")
    stated = headers.get("warc-block-digest")
    if stated and stated != f"sha1:{digest(block)}":
        raise Damaged("the block does not have its digest")
    return headers, block, stop


def _record_at(data: bytes, at: int) -> Record:
    """The record at a place, a gzip member or a plain one."""
    if not data.startswith(_MEMBER, at):
        headers, block, stop = _parse(data, at)
        return Record(headers, block, at, stop)
    unpacker = zlib.decompressobj(31)
    parts, position = [], at
    try:
        while not unpacker.eof and position < len(data):
            chunk = data[position:position + (1 << 16)]
            parts.append(unpacker.decompress(chunk))
            position += len(chunk)
    except zlib.error as problem:
        raise Damaged(f"the member does not unpack: {problem}") from None
    if not unpacker.eof:
        raise Damaged("the member does not end")
    whole = b"".join(parts)
    headers, block, stop = _parse(whole, 0)
    if stop != len(whole):
        raise Damaged("the member holds more than a record")
    return Record(headers, block, at, position - len(unpacker.unused_data))


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """All records of an archive that pass the checks, and the gaps between as (start, stop, reason)."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        if lost is None and data[at] == 0:
            at = _ZEROS.match(data, at).end()
            continue
        try:
            found = _record_at(data, at)
        except Damaged as problem:
            if lost is None:
                lost, reason = at, str(problem)
            start = _START.search(data, at + 1)
            at = start.start() if start else len(data)
            continue
        if lost is not None:
            yield lost, at, reason
            lost = None
        yield found
        at = found.stop
    if lost is not None:
        yield lost, len(data), reason


def write(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED) -> None:
    """Write pages (page_id, url, html) to archives below a folder.

    Which payloads are equal is told by their digests, counted before anything is moved. Spark
    writes the members as rows of text, so every file system it knows will do, and a lost task
    leaves nothing behind.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit("").cast("binary"))
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    sums = given.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    shared = (
        sums.where(F.col("size") >= least_shared).groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
        .select(again("digest").alias("key"), "last")
    )
    keyed = given.withColumn("key", F.xxhash64(F.lit("again"), F.sha1("payload")))
    joined = keyed.join(shared, "key", "left").select("page_id", "url", "payload", F.when(
        F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [record(i, u, p, r) for i, u, p, r in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to")))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    made = joined.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    made.write.option("lineSep", _PAD).option("maxRecordsPerFile", RECORDS).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Everything in the archives below a folder: (file, start, stop, page_id, type, refers_to,
    payload_bytes, payload_digest, payload, gap).

    Rows with a `gap` are stretches of bytes that hold no valid record, with the reason. Size and
    digest of a record's payload are those of its page, for revisits taken from the header.
    """
    schema = ("file string, start long, stop long, page_id long, type string, refers_to long, "
              "payload_bytes long, payload_digest string, payload binary, gap string")
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found.group(1)) if found else None

    def row(file: str, found: Record | tuple[int, int, str]) -> tuple:
        if isinstance(found, tuple):
            return file, found[0], found[1], None, None, None, None, None, None, found[2]
        h = found.headers
        size = re.search(rb"(?i)\r\nContent-Length: *(\d+)", found.block[:found.block.find(b"\r\n\r\n") + 1])
        revisit = h.get("warc-type") == "revisit"
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        return (file, found.start, found.stop, number(h.get("warc-record-id")), h.get("warc-type"),
                number(h.get("warc-refers-to")), int(size.group(1)) if revisit and size else len(found.payload),
                stated if revisit else digest(found.payload), None if revisit else found.payload, None)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows: list[tuple] = []
                held = 0
                for found in salvage(content.as_py()):
                    rows.append(row(file, found))
                    held += len(rows[-1][8] or b"") + 200
                    if held > 1 << 22:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(task, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read
    back from archives written for the purpose."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write(pages, folder)
    return read(spark, folder).where("gap is null").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


#: The same in DuckDB SQL. Base32 takes five bits a letter, so five hexadecimal digits are four letters.
SQL = """
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
        (('0x' || substr(sha1(payload), (5 * (i // 4) + 1)::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
