"""Legacy ARC archives to WARC: writing, conversion and reading.

ARC records are parsed by the header line of their version and by declared lengths; record
ids, timestamps, types and digests that ARC lacks are synthesised.  Each record is a gzip member
of its own, so archives can be entered at any record, and every file opens with its version
block or warcinfo.  Files are put together by workers up to a number of bytes and written by
Spark's own writers, so any storage that Spark reaches will do, and a lost executor's files are
simply written again.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Field names of the header line by ARC version (fixed by the format).
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
FIELDS = {1: len(V1.split()), 2: len(V2.split())}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Equal payloads below so many bytes are not worth a revisit record.
LEAST = 100
#: Repeated digests that may be broadcast, of some hundred bytes each.
FEW = 100_000
DATE = "20240101000000"
#: A file is closed once it holds so many bytes.
ROLL = 16 << 20
#: A header line has so many bytes at most.
LINE = 1 << 20


@dataclass
class Record:
    """One archived capture."""

    url: str
    date: str
    mime: str
    block: bytes
    version: int = 1
    ip: str = "0.0.0.0"
    status: int | None = None
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def parts(self) -> tuple[bytes, bytes]:
        """HTTP head (with its blank line) and payload; a block without a head is all payload."""
        if self.block.startswith(b"HTTP/") and (end := self.block.find(b"\r\n\r\n")) >= 0:
            return self.block[: end + 4], self.block[end + 4 :]
        return b"", self.block


def http_head(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}


# --- ARC ----------------------------------------------------------------------------------


def _token(text: str | None) -> str:
    """A header line's field: no white space, never empty."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "") or "-"


def arc_record(r: Record) -> bytes:
    """Header line and block; the terminating newline is the writer's."""
    fields = [_token(r.url), _token(r.ip), r.date, _token(r.mime)]
    if r.version == 2:
        fields += [str(r.status or 200), "-", "-", "0", "-"]
    return " ".join([*fields, str(len(r.block))]).encode() + b"\n" + r.block


def arc_opening(version: int, name: str, date: str = DATE) -> bytes:
    """The version block with which an ARC file begins."""
    body = f"{version} 0 almanac\n{V1 if version == 1 else V2}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def opened(data: bytes | BinaryIO) -> BinaryIO:
    """A stream over an archive's plain bytes; gzip, of any number of members, is told by its first bytes."""
    if not isinstance(data, bytes):
        return data
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _heading(stream: BinaryIO) -> bytes:
    """The next line that isn't blank, or nothing at the end."""
    while (line := stream.readline(LINE)) and not line.strip(b"\r\n"):
        pass
    return line.lstrip(b"\r")


def parse_arc(data: bytes | BinaryIO) -> Iterator[Record]:
    """Records of an ARC file, version block left out; of a stream one record at a time is held.

    The version block sets the number of header fields; without one it is told by the first
    line.  Urls may hold spaces, so fields count from the right.  Raises ValueError for a
    malformed header line or a declared length that runs past the end.
    """
    stream, version = opened(data), None
    while raw := _heading(stream):
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        opening = line.startswith("filedesc://")
        fields = None
        for v in [1] if opening else [version] if version else [2, 1]:
            got = line.rsplit(" ", FIELDS[v] - 1)
            if len(got) == FIELDS[v] and got[-1].isdigit() and re.fullmatch(r"\d{8,14}", got[2]) and (v == 1 or got[4].isdigit()):
                fields, found = got, v
                break
        block = stream.read(int(fields[-1])) if fields and raw.endswith(b"\n") else None
        if block is None or len(block) < int(fields[-1]):
            raise ValueError(f"bad ARC record: {line[:80]!r}")
        if opening:
            version = 2 if block[:1] == b"2" else 1
            continue
        version = version or found
        yield Record(fields[0], fields[2], fields[3], block, found, fields[1], int(fields[4]) if found == 2 else None)


# --- WARC ---------------------------------------------------------------------------------


def warc_date(date: str) -> str:
    """ARC's digits, of which the time may be missing or cut, as WARC's UTC timestamp."""
    d = date + "00000000000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record up to its terminator, which is the writer's."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def warc_opening(name: str, date: str = DATE) -> bytes:
    body = b"software: almanac\r\nformat: WARC File Format 1.1\r\n"
    return warc_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", warc_date(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def convert(r: Record, page_id: int | None, first: tuple[int, str, str] | None = None) -> bytes:
    """The WARC record equivalent to an ARC record; a revisit of `first`, a page's id, url and date, where that is given."""
    head, payload = r.parts
    digest = sha(payload)
    block = r.block if first is None else head
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id("page", page_id, r.url, r.date)),
        ("WARC-Date", warc_date(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{sha(block)}"),
        ("Content-Type", "application/http;msgtype=response" if head else r.mime),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if first is not None:
        headers += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", record_id("page", *first)),
            ("WARC-Refers-To-Target-URI", first[1]),
            ("WARC-Refers-To-Date", warc_date(first[2])),
            ("X-Refers-To-Page-Id", str(first[0])),
        ]
    return warc_bytes(headers, block)


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record, one at a time; raises ValueError for malformed ones."""
    stream = opened(data)
    while line := _heading(stream):
        if not line.startswith(b"WARC/"):
            raise ValueError(f"bad WARC record: {line[:80]!r}")
        headers = {}
        while (raw := stream.readline(LINE)).strip(b"\r\n"):
            k, _, v = raw.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        if not raw or "content-length" not in headers:
            raise ValueError(f"WARC header cut short: {headers}")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"WARC record {headers.get('warc-record-id')} is cut short")
        yield headers, block


# --- DataFrame operators ------------------------------------------------------------------


def member(record: bytes) -> bytes:
    """A record as a gzip member that ends with a zero byte, as members of less than 16 MB do; larger ones are followed by an empty one."""
    made = gzip.compress(record, 1, mtime=0)
    return made if made[-1] == 0 else made + gzip.compress(b"", 1, mtime=0)


def files(records: Iterable[bytes], opening: bytes, roll: int) -> Iterator[bytes]:
    """Whole files of members, each with its opening record first and closed once it holds `roll` bytes."""
    held, size = [member(opening)], 0
    for record in records:
        held.append(member(record))
        size += len(held[-1])
        if size >= roll:
            yield b"".join(held)
            held, size = [member(opening)], 0
    if size:
        yield b"".join(held)


def _write(rows: DataFrame, path: str) -> None:
    """One file for each row of `rows`; the zero byte that ends every file is the writer's line separator."""
    whole = F.expr("substring(record, 1, length(record) - 1)").cast("string")
    rows.select(whole.alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of 256 rows, or of fewer that hold `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) == 256 or size >= most:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL) -> None:
    """Archives every page as an ARC record: by even and odd partitions of either version.

    Null html is an empty payload, a null url is written as "-", a null id not at all; repeated
    rows are written as often as given; an empty table gives no files.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = part % 2 + 1

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html in zip(*batch.columns, strict=True):
                    payload = (html.as_py() or "").encode()
                    told = "" if page.as_py() is None else f"X-Page-Id: {page.as_py()}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{told}Content-Length: {len(payload)}\r\n\r\n".encode()
                    yield arc_record(Record(url.as_py() or "", DATE, "text/html", head + payload, version, status=200)) + b"\n"

        for whole in files(records(), arc_opening(version, f"part-{part}.arc") + b"\n", roll):
            yield pa.record_batch([pa.array([whole], pa.binary())], names=["record"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    _write(rows.mapInArrow(work, "record binary"), path)


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """(page_id, url, date, mime, ip, version, block, payload_bytes, payload_digest) of every ARC record under a path.

    Blocks are null where not asked for.  Records without a page's id have a null one; files
    without records give no rows; a malformed file is an error.  A file must fit in a worker's
    memory as it is stored; of its plain bytes one record at a time is held.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
    names = ["page_id", "url", "date", "mime", "ip", "version", "block", "payload_bytes", "payload_digest"]

    def told(r: Record) -> tuple:
        head, payload = r.parts
        page = http_head(head).get("x-page-id")
        return int(page) if page else None, r.url, r.date, r.mime, r.ip, r.version, r.block if blocks else None, len(payload), sha(payload)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(map(told, parse_arc(content.as_py())), kinds, names)

    return _files(spark, path).mapInArrow(work, "page_id long, url string, date string, mime string, ip string, version int, block binary, payload_bytes long, payload_digest string")


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST, roll: int = ROLL) -> None:
    """Converts all ARC files under a path to WARC.

    Of equal payloads of at least `least` bytes the smallest page id stays a response.  Digests
    are counted first, without the blocks, and combined before their shuffle.  Only those that
    occur more than once are joined back: broadcast if they are FEW at most, so that no block
    is shuffled, else by a shuffled join on the digest, whose hot keys adaptive execution
    splits.  Records that share the smallest id are responses all, null ids are never the
    smallest, and where all ids are null all are responses.  Archives without records give no files.
    """
    records = read_arc(spark, arc_path)
    least_of = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date")))
    again = cut(
        read_arc(spark, arc_path, blocks=False).filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest").agg(least_of.alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select("payload_digest", "first")
    )
    again = F.broadcast(again) if again.count() <= FEW else again
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    rows = records.join(again, "payload_digest", "left").select("page_id", "url", "date", "mime", "ip", "block", *(first[x].alias(f"first_{x}") for x in ("page_id", "url", "date")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def converted() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    page, url, date, mime, ip, block, *of = (x.as_py() for x in row)
                    yield convert(Record(url, date, mime, block, ip=ip), page, None if of[0] is None else tuple(of)) + b"\r\n\r\n"

        for whole in files(converted(), warc_opening(f"part-{TaskContext.get().partitionId()}.warc") + b"\r\n\r\n", roll):
            yield pa.record_batch([pa.array([whole], pa.binary())], names=["record"])

    _write(rows.mapInArrow(work, "record binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, date, record_id, payload_bytes, payload_digest, record_type, refers_to, payload) of responses and revisits.

    Digests of responses are computed from what was read and compared with what is declared;
    ValueError where they differ.  Revisits have no payload.  Files without records give no rows.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "date", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    number = lambda x: int(x) if x is not None else None

    def told(content: bytes) -> Iterator[tuple]:
        for h, block in parse_warc(content):
            kind = h["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            digest, size, payload = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"]), None
            if kind == "response":
                _, payload = Record("", "", "", block).parts
                if sha(payload) != digest or len(payload) != size:
                    raise ValueError(f"digest or length of {h['warc-record-id']} does not hold")
            yield number(h.get("x-page-id")), h["warc-target-uri"], h["warc-date"], h["warc-record-id"], size, digest, kind, number(h.get("x-refers-to-page-id")), payload

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(told(content.as_py()), kinds, names)

    return _files(spark, path).mapInArrow(work, "page_id long, url string, date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def unanswered(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes) of revisits whose response, of equal digest and length, isn't there."""
    asked = records.filter("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    there = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return asked.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Pages to ARC, to WARC, and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Payloads of responses are hashed anew, and revisits are held against their responses;
    ValueError where one doesn't hold.  Defined cases: null html is an empty payload, null urls
    are written as "-"; repeated rows come back once each; an empty table gives no rows.
    """
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc", id_col, url_col, html_col, roll)
    convert_archives(spark, f"{base}/arc", f"{base}/warc", least, roll)
    records = cut(read_warc(spark, f"{base}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    made = spark._jvm.org.apache.hadoop.fs.Path(base)  # the archives were made here only to be read back
    made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)
    if not (lost := unanswered(records)).isEmpty():
        raise ValueError(f"a revisit has no response: {lost.first()}")
    return records


#: The same in DuckDB.
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
