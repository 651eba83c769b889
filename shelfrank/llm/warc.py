"""WARC archives: a writer with revisit records, and a salvage reader.

The writer puts one gzip member per record into files of bounded size. Records with equal payloads
are written once; later ones refer to it. The reader checks every record (compression, version
line, length, closing blank lines, digests). Where a check fails it searches for the next member or
version line from which a whole record can be read, goes on there, and reports the bytes in between
as a gap. It reads one file at a time and holds no more than that file and one record.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1
import re
from string import ascii_letters, digits, punctuation
from urllib.parse import quote
from uuid import uuid4
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.scratch import Scratch

FILE_BYTES = 8 << 20  # a file is closed once it has so many bytes
PIECE = 1 << 16
DATE = "2000-01-01T00:00:00Z"
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing --------------------------------------------------------------------------------------


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record without it. Control characters,
    blanks and other than ASCII characters of the address are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=ascii_letters + digits + punctuation, errors='replace')}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(level=6, wbits=31)
    return packer.compress(record) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records of ``pages`` (page_id, url, payload binary, digest, refers_to) to files in a
    shared folder, and returns the finished files' names and numbers of records when it is run.

    Every attempt of a task writes files with names of its own; only files that the finished
    attempt returned belong to the archive, so a lost executor leaves no record twice."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        records = size = 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    name, records, size = f"{uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packed = member(make_record(*row))
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pa.RecordBatch.from_pydict({"name": [n for n, _ in done], "records": [r for _, r in done]}, pa.schema([("name", pa.string()), ("records", pa.int64())]))

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "name string, records long")


def with_revisits(pages: DataFrame, scratch: Scratch, min_bytes: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, payload) with the payload's digest and ``refers_to``: of records with
    equal payloads of at least ``min_bytes`` the one with the largest page_id keeps its payload, the
    others refer to it. Repeated rows of that page_id all keep theirs, as does a null page_id."""
    hashed = pages.withColumn("digest", F.sha1("payload"))
    large = (F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()
    groups = hashed.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    repeated = scratch.keep(groups.where(F.col("n") > 1).select("digest", "keeper"), "repeated")
    refers = F.when(large & (F.col("keeper") != F.col("page_id")), F.col("keeper"))
    return hashed.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


# --- reading --------------------------------------------------------------------------------------


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("content-type", "") else self.block


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Broken(ValueError):
    """A check of a record failed."""


def _check_digest(headers: dict[str, str], field: str, data: bytes) -> None:
    kind, _, told = headers.get(field, "").partition(":")
    if kind == "sha1" and sha1(data).hexdigest() != told:
        raise Broken(f"{field} differs")


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record at a place of uncompressed data, and the place after it."""
    version = VERSION_LINE.match(data, at)
    if not version:
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Broken("header without end")
    headers = {}
    for line in data[version.end():end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line without colon")
        headers[name.strip().lower()] = value.strip()
    if missing := [x for x in MANDATORY if x not in headers]:
        raise Broken(f"no {missing[0]}")
    told = headers["content-length"]
    if not (told.isascii() and told.isdigit()):
        raise Broken("no content length")
    begin, stop = end + 4, end + 4 + int(told)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Broken("record without closing lines")
    record = Record(at, stop + 4 - at, headers, data[begin:stop])
    _check_digest(headers, "warc-block-digest", record.block)
    if headers.get("warc-type") != "revisit":
        _check_digest(headers, "warc-payload-digest", record.payload())
    return record, stop + 4


def _inflate(content: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The member at a place, unpacked as far as it can be, the place after it, and what is wrong with it."""
    unpacker, parts, place = zlib.decompressobj(wbits=31), [], at
    view = memoryview(content)
    try:
        while not unpacker.eof and place < len(content):
            parts.append(unpacker.decompress(view[place:place + PIECE]))
            place += PIECE
    except zlib.error as e:
        parts.append(_before_error(content, at, place))
        return b"".join(parts), place, f"member: {e}"
    if not unpacker.eof:
        return b"".join(parts), len(content), "member: cut off"
    return b"".join(parts), min(place, len(content)) - len(unpacker.unused_data), None


def _before_error(content: bytes, at: int, place: int) -> bytes:
    """What a damaged member gives from ``place`` on before the error: an unpacker that fails hands out nothing
    of the piece it was given, so the piece is given byte by byte."""
    unpacker, parts = zlib.decompressobj(wbits=31), []
    for begin in range(at, place, PIECE):
        unpacker.decompress(content[begin:begin + PIECE])
    try:
        for i in range(place, min(place + PIECE, len(content))):
            parts.append(unpacker.decompress(content[i:i + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def _salvage_plain(data: bytes) -> Iterator[Record | Gap]:
    at = 0
    while at < len(data):
        try:
            record, after = parse_record(data, at)
            yield record
            at = after
        except Broken as e:
            start, following = at, VERSION_LINE.search(data, at + 1)
            while following:
                try:
                    parse_record(data, following.start())
                    break
                except Broken:
                    following = VERSION_LINE.search(data, following.start() + 1)
            at = following.start() if following else len(data)
            yield Gap(start, at - start, str(e))


def salvage(content: bytes) -> Iterator[Record | Gap]:
    """All records of a file that pass the checks, in order, and the gaps between them. Places of
    records in a gzip member are those of the member. A file may mix members and plain records. Of a damaged
    member the records that can be unpacked and pass the checks come first, then the gap over its bytes.
    If all that was unpacked passes and only the member's own check sum fails or is cut off, the damage may be
    in any header, which no digest covers, and none is taken."""
    end = len(content)
    at = magic = line = 0  # the next member and version line known
    while at < end:
        start, reason, rescued = at, None, []
        while at < end:
            try:
                if content.startswith(GZIP_MAGIC, at):
                    data, after, trouble = _inflate(content, at)
                    found = list(_salvage_plain(data))
                    sound = [x for x in found if isinstance(x, Record)]
                    if trouble:
                        if len(sound) < len(found):
                            for x in sound:
                                x.offset = at
                            rescued += sound
                        raise Broken(trouble)
                    if not sound:
                        raise Broken(found[0].reason if found else "empty member")
                    for x in found:
                        x.offset, x.length = at, (after - at if isinstance(x, Record) else x.length)
                else:
                    record, after = parse_record(content, at)
                    found = [record]
                break
            except Broken as e:
                reason = reason or str(e)
                if magic <= at:
                    magic = place if (place := content.find(GZIP_MAGIC, at + 1)) >= 0 else end
                if line <= at:
                    line = found.start() if (found := VERSION_LINE.search(content, at + 1)) else end
                at = min(magic, line)
        else:
            found, after = [], at
        for x in rescued:
            x.length = at - x.offset
            yield x
        if at > start:
            yield Gap(start, at - start, reason)
        yield from found
        at = after


ROWS = (
    "path string, offset long, length long, gap boolean, reason string, record_type string, page_id long, "
    "refers_to long, payload_bytes long, payload_digest string, url string, payload binary"
)


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _as_row(path: str, x: Record | Gap, with_payload: bool) -> dict:
    if isinstance(x, Gap):
        return {"path": path, "offset": x.offset, "length": x.length, "gap": True, "reason": x.reason}
    revisit, payload = x.headers.get("warc-type") == "revisit", x.payload()
    if revisit:  # the header that was kept tells the length of the payload that was not
        told = re.search(rb"\r\ncontent-length: *(\d+)", x.block, re.IGNORECASE)
        size, digest = int(told[1]) if told else None, x.headers.get("warc-payload-digest", "").partition(":")[2]
    else:
        size, digest = len(payload), sha1(payload).hexdigest()
    return {
        "path": path, "offset": x.offset, "length": x.length, "gap": False, "record_type": x.headers.get("warc-type"),
        "page_id": _page(x.headers.get("warc-record-id")), "refers_to": _page(x.headers.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "url": x.headers.get("warc-target-uri"),
        "payload": payload if with_payload and not revisit else None,
    }


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of ``files`` (path, content; as Spark's binaryFile source gives them).

    Null or empty contents give no rows; a file without any sound record gives one gap. A gap row
    has path, offset, length and reason. Record rows: see ROWS; a revisit has no payload, its
    payload_bytes and payload_digest are those of the full payload."""
    shape = pa.schema([
        (n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t])
        for n, t in (c.split() for c in ROWS.split(", "))
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for x in salvage(content.as_py() or b""):
                    rows.append(_as_row(path.as_py(), x, with_payload))
                    held += len(rows[-1].get("payload") or b"") + 500
                    if held > FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, shape)

    return files.select("path", "content").mapInArrow(read, ROWS)


def open_archives(spark: SparkSession, folder: str, finished: DataFrame | None = None) -> DataFrame:
    """The files of a folder (path, content); with ``finished`` only those named there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    if finished is None:
        return files.select("path", "content")
    return files.join(finished, F.element_at(F.split("path", "/"), -1) == finished["name"], "left_semi").select("path", "content")


def archive_pages(pages: DataFrame, html: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url and the html) and returns what is read back
    from the archives, without payloads: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url.

    A null html is an empty payload; a null url is left out; a null page_id stays null. Repeated rows
    give a record each. No pages give no rows. A gap in what was just written is an error."""
    scratch = Scratch(pages.sparkSession, "warc")
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    )
    folder = scratch.path("archives")
    finished = scratch.keep(write_archives(with_revisits(given, scratch, min_bytes), folder), "finished")
    spark = pages.sparkSession
    if finished.limit(1).count() == 0:
        return spark.createDataFrame([], ROWS).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    read = read_archives(open_archives(spark, folder, finished), with_payload=False)
    sound = F.when(F.col("gap"), F.raise_error(F.concat(F.lit("gap in "), F.col("path"), F.lit(": "), F.col("reason")))).otherwise(F.col("record_type"))
    return read.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to", "url")
