"""WARC records in ZIP archives: a writer, and a reader that finds its way by directories and indexes.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (each record a gzip
member of its own) and ``indexes/index.cdx`` (one line a record: offset, length, record id). The writer ends every
archive with a ZIP64 directory. The reader fetches the file's tail, follows the end record (and the ZIP64 locator if
there is one) to the central directory, reads the index member and then each record by its byte range.

``entries`` takes any stored members with records, each with its lines in an index.

Files are reached through pyarrow's filesystems by URI, so that they can lie in any store that executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checked, cut_lineage, shared_dir, table

ARCHIVE_BYTES = 64 << 20  # an archive is closed when its records reach this size
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Signatures and marks of the ZIP format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64, MARK32, MARK16 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0xFFFFFFFF, 0xFFFF
STORED = 0
RECORDS = (".warc.gz", ".warc")  # names of members that hold records


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP ---------------------------------------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, with a ZIP64 end record and locator; sizes beyond 32 bits go to ZIP64 fields."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, crc, n, raw = len(out), zlib.crc32(data), len(data), name.encode()
        big = n >= MARK32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        size = MARK32 if big else n
        out += struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, STORED, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        out += data
        wide = struct.pack("<QQ", n, n) * big + struct.pack("<Q", at)
        central += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, STORED, 0, 0x21, crc, size, size, len(raw), len(wide) + 4, 0, 0, 0, 0, MARK32) + raw + struct.pack("<HH", 1, len(wide)) + wide
    start, count = len(out), len(members)
    out += central
    end64 = len(out)
    out += struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, len(central), start)
    out += struct.pack("<IIQI", LOCATOR64, 0, end64, 1)
    out += struct.pack("<IHHHHIIH", END, 0, 0, MARK16, MARK16, MARK32, MARK32, 0)
    return bytes(out)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class ByRange:
    """Reads byte ranges of a file and counts them."""

    def __init__(self, file, size: int):
        self.file, self.size, self.reads = file, size, 0

    def __call__(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError(f"range {at}+{n} lies outside the file's {self.size} bytes")
        self.reads += 1
        self.file.seek(at)
        return self.file.read(n)


def directory(read: ByRange) -> dict[str, Member]:
    """Members by name, from the central directory. ValueError if it is damaged or the file no ZIP."""
    tail_at = max(0, read.size - (22 + 0xFFFF))
    tail = read(tail_at, read.size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at + tail_at >= 20 and (count == MARK16 or MARK32 in (length, start)):
        mark, _, end64, _ = struct.unpack("<IIQI", read(tail_at + at - 20, 20))
        if mark == LOCATOR64:
            record = read(end64, 56)
            if struct.unpack_from("<I", record)[0] != END64:
                raise ValueError("the ZIP64 locator points to no end record")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, out, p = read(start, length), {}, 0
    for _ in range(count):
        if len(raw) < p + 46 or struct.unpack_from("<I", raw, p)[0] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", raw, p + 10)[0]
        packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, p + 20)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name, extra = raw[p + 46 : p + 46 + n_name].decode("utf-8", "replace"), raw[p + 46 + n_name : p + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # the fields that are all ones outside follow here, in this order
                q = e + 4
                if size == MARK32:
                    size, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                if packed == MARK32:
                    q += 8
                if header == MARK32:
                    header = struct.unpack_from("<Q", extra, q)[0]
            e += 4 + n
        out[name] = Member(name, method, size, header)
        p += 46 + n_name + n_extra + n_comment
    return out


def data_offset(read: ByRange, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed: its records cannot be read by range")
    head = read(member.header, 30)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def entries(read: ByRange, path: str = "archive") -> list[tuple[int, int]]:
    """Offset in the file and length of every record of every member under archive/ that the indexes list.

    An index is a stored member under indexes/. Its lines have an offset, a length, a record id and, where the archive
    has several members with records, a member's file name; a line without one belongs to the only member. ValueError
    where a member with records is in no index or a line names no member."""
    members = directory(read)
    bodies = {n.removeprefix("archive/"): m for n, m in members.items() if n.startswith("archive/") and n.endswith(RECORDS)}
    out, listed = [], set()
    starts = {n: data_offset(read, m) for n, m in bodies.items()}
    for index in (m for n, m in members.items() if n.startswith("indexes/") and not n.endswith("/")):
        lines = [x.split(" ") for x in read(data_offset(read, index), index.size).decode().split("\n") if x]
        listed |= set(bodies) if len(bodies) == 1 else set()
        for line in lines:
            name = line[3] if len(line) > 3 else next(iter(bodies)) if len(bodies) == 1 else ""
            if name not in bodies or int(line[0]) + int(line[1]) > bodies[name].size:
                raise ValueError(f"{path}: an index line lies in no member: {' '.join(line)}")
            listed.add(name)
            out.append((starts[name] + int(line[0]), int(line[1])))
    if missing := sorted(n for n, m in bodies.items() if n not in listed and m.size):
        raise ValueError(f"{path}: no index lists the records of {', '.join(missing)}")
    return out


# --- WARC --------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, gzipped. A revisit has the response's HTTP head, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha}", f"Content-Length: {len(block)}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of one gzipped record."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}, payload


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


# --- Spark -------------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha (hex SHA-1 of the payload) and first: the smallest page_id of equal payloads.

    A null html is the empty payload. Rows that repeat the smallest page_id are responses all; null page_ids are
    never the smallest unless there is no other, then they are responses. Only these columns are read; an empty table
    gives no rows. Runs a job when called."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Only payloads that repeat need a first page. If their hashes can be broadcast, no html is shuffled.
    firsts = cut_lineage(src.groupBy("sha").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    repeated = F.col("least").isNotNull() | F.col("page_id").isNull()
    return src.join(checked(firsts), "sha", "left").withColumn("first", F.when(repeated, F.col("least")).otherwise(F.col("page_id"))).drop("least")


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives into the folder (a URI) and returns their paths, sizes and numbers of records.

    A task writes archives under names of its own; only the names that successful tasks return are ever read, so
    retried and speculative tasks do no harm. The result is a written table: evaluating it again writes nothing.
    """

    def flush(fs: pyarrow.fs.FileSystem, at: str, records: list[bytes], lines: list[str]) -> pa.RecordBatch:
        body = zip_stored([(DATA, b"".join(records)), (INDEX, "\n".join(lines).encode())])
        path = f"{at}/{uuid.uuid4().hex}.zip"
        with fs.open_output_stream(path) as out:
            out.write(body)
        return pa.RecordBatch.from_arrays([pa.array([path.removeprefix(at).lstrip("/")]), pa.array([len(body)]), pa.array([len(records)])], ["archive", "bytes", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        records: list[bytes] = []
        lines: list[str] = []
        size = 0
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first"))):
                page, first, payload = page_id.as_py(), first.as_py(), html.as_py().encode("utf-8", "surrogatepass")
                raw = record(page, url.as_py(), payload, digest(payload), first, page != first)
                lines.append(f"{size} {len(raw)} {'' if page is None else page}")
                records.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield flush(fs, at, records, lines)
                    records, lines, size = [], [], 0
        if records:
            yield flush(fs, at, records, lines)

    return cut_lineage(planned.select("page_id", "url", "html", "first").mapInArrow(run, "archive string, bytes long, records long"))


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives (column ``archive``, paths under the folder), read by range.

    payload_bytes and payload_digest are the full payload's, from the payload of a response (which must have the
    digest its header names) and from the headers of a revisit. All members of an archive that hold records are read,
    by their indexes; an archive with an empty index gives no rows. A damaged archive raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                path = f"{at}/{name}"
                with fs.open_input_file(path) as file:
                    read = ByRange(file, file.size())
                    rows = []
                    for at_byte, length in entries(read, path):
                        headers, http, payload = parse(read(at_byte, length))
                        revisit = headers["warc-type"] == "revisit"
                        sha = headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and digest(payload) != sha:
                            raise ValueError(f"{path}: a payload does not have the digest of its header")
                        size = int(http["content-length"]) if revisit else len(payload)
                        rows.append((_page(headers["warc-record-id"]), size, sha, headers["warc-type"], _page(headers["warc-refers-to"]) if revisit else None))
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = archives.select("archive").repartition(max(1, min(archives.count(), 10_000)), "archive")
    return spread.mapInArrow(run, SCHEMA)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written to archives in the shared folder and read back. Null html is the empty payload. The archives
    are the result's source and stay in the folder. Writes when called."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(plan_records(table(spark, sf_dir, "pages")), folder), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
