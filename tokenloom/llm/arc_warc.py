"""Legacy archives (ARC versions 1 and 2) to WARC: write, convert, read back.

Archives are written by Spark's own text writer, one row per archive, so that a
lost task leaves no half file. An archive ends before it would pass ARCHIVE_BYTES (a
larger record has one to itself), so that readers may hold one as a whole. A record's length is
declared in bytes; readers go by declared lengths alone and never search for the next
header. Equal payloads are found by digest in a small table beside the archives; no
payload goes through a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import join_groups
from tokenloom.session import materialize, scratch_path

#: Bytes of one archive before it is compressed.
ARCHIVE_BYTES = 16 << 20
#: Bytes of the revisits that are broadcast at once; archives with more in all are converted in turns.
REVISIT_BYTES, ONE_REVISIT = 64 << 20, 200
#: Smaller payloads are never replaced by a revisit.
MIN_REVISIT = 1_000
ARC_DATE = "20240101000000"
#: Fixed values of the formats.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, uri string, page_id long, payload_bytes long, payload_digest string"


def archives(records: Iterator[Callable[[int], bytes]], size: int, opening: Callable[[int], bytes] | None = None, end: bytes = b"\n") -> Iterator[pa.RecordBatch]:
    """One row per archive: an opening record, then records while they fit; ``end`` stands between two. All are made for the archive's number."""
    held: list[bytes] = []
    total, number = 0, 0

    def finished() -> pa.RecordBatch:
        first = [opening(number)] if opening else []
        return pa.RecordBatch.from_arrays([pa.array([end.join([*first, *held])], pa.binary())], ["value"])

    for record in records:
        made = record(number)
        if held and total + len(made) > size:
            yield finished()
            held, total, number = [], 0, number + 1
            made = record(number)
        held.append(made)
        total += len(made) + len(end)
    if held:
        yield finished()


def write_archives(rows: DataFrame, path: str, end: str) -> None:
    """One gzipped file per row of ``value``."""
    writer = rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    writer.option("lineSep", end).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, date: str = ARC_DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes (page_id, url, html) as gzipped ARC files, versions 1 and 2 in turn by partition.

    A null html is empty, a null or empty url is written as ``-``; white space in a
    url is percent-encoded. A null page_id has no header of its own. Other columns are
    not archived.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        version = str(partition % 2 + 1)

        def name(number: int) -> str:
            return f"arc-{partition:05d}-{number:05d}.arc"

        def opening(number: int) -> bytes:
            body = f"{version} 0 tokenloom\n{ARC_FIELDS[version]}\n"
            middle = "" if version == "1" else f"200 - - 0 {name(number)} "
            return f"filedesc://{name(number)} 0.0.0.0 {date} text/plain {middle}{len(body) + 1}\n{body}".encode()

        def record(url: str | None, page_id: int | None, html: bytes | None, number: int) -> bytes:
            link = re.sub(r"[\t\n\x0b\x0c\r ]", lambda m: f"%{ord(m.group()):02X}", url or "") or "-"
            body = html or b""
            own = "" if page_id is None else f"\r\nX-Page-Id: {page_id}"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}{own}\r\n\r\n".encode()
            middle = "" if version == "1" else f"200 - - 0 {name(number)} "
            return f"{link} 0.0.0.0 {date} text/html {middle}{len(head) + len(body)}\n".encode() + head + body

        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        yield from archives((partial(record, *row) for row in rows), archive_bytes, opening)

    html = F.col("html").cast("binary")
    write_archives(pages.select("url", "page_id", html.alias("html")).mapInArrow(written, "value binary"), path, "\n")


class ArcRecord:
    """One record of an ARC file, with what a WARC needs of it."""

    def __init__(self, line: list[str], version: str, block: bytes, archive: str, number: int):
        self.uri, self.ip, self.date, self.mime = line[0], line[1], line[2], line[3]
        self.status = line[4] if version == "2" else None
        self.block, self.archive = block, archive
        self.is_http = block.startswith(b"HTTP/")
        split = block.find(b"\r\n\r\n")
        cut = split + 4 if self.is_http and split >= 0 else 0
        self.head, self.payload = block[:cut], block[cut:]
        found = re.search(rb"\r\nX-Page-Id: (-?[0-9]+)\r\n", self.head)
        self.page_id = int(found.group(1)) if found else None
        self.digest = hashlib.sha1(self.payload).hexdigest()
        name = f"{archive} {number} {self.uri} {self.date} {self.digest}"
        self.record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"

    @property
    def warc_date(self) -> str:
        # A date that was written short means its first moment.
        d = (self.date + "00000101000000"[len(self.date) :])[:14]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or gzipped, by declared lengths; header lines by the version it states.

    Only the record at the file's start may be the one that opens an archive: a later
    one whose url begins with ``filedesc://`` is a record like others.
    """
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    version, archive, number, at_start = "1", "", 0, True
    while line := stream.readline():
        if line == b"\n":
            continue
        fields = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        try:
            block = stream.read(int(fields[-1]))
        except ValueError:
            raise ValueError(f"not an ARC header line: {line[:200]!r}") from None
        opens, at_start = at_start and fields[0].startswith("filedesc://"), False
        if opens:
            version, archive = block[:1].decode(), fields[0].removeprefix("filedesc://")
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version in {fields[0]}")
            continue
        if len(fields) != len(ARC_FIELDS[version].split(" ")):
            raise ValueError(f"an ARC version {version} header line has other fields: {line[:200]!r}")
        yield ArcRecord(fields, version, block, archive, number)
        number += 1


def warc_record(r: ArcRecord, original: dict | None) -> bytes:
    """The WARC record of an ARC record, without the blank lines that end it; ``original`` makes it a revisit."""
    digest = base64.b32encode(bytes.fromhex(r.digest)).decode()
    block = r.head if original else r.block
    headers = [
        ("WARC-Type", "revisit" if original else "response" if r.is_http else "resource"),
        ("WARC-Record-ID", r.record_id),
        ("WARC-Date", r.warc_date),
        ("WARC-Target-URI", r.uri),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(r.payload))),
    ]
    if r.page_id is not None:
        headers.append(("WARC-Page-ID", str(r.page_id)))
    if original:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original["record_id"])]
        if original["page_id"] is not None:
            headers.append(("WARC-Refers-To-Page-ID", str(original["page_id"])))
    headers.append(("Content-Type", "application/http; msgtype=response" if r.is_http else r.mime))
    headers.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{WARC_VERSION}\r\n{lines}\r\n".encode() + block


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record, by declared lengths."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        yield headers, block


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the archives below a folder, one row each: of ARCHIVE_BYTES, or one record, before compression."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True)
    return read.load(path).select("path", "content")


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about 4 MB."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 200
        if total > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arc_index(arc_files: DataFrame) -> DataFrame:
    """One row per ARC record: path, record_id, uri, page_id, payload_bytes, payload_digest."""
    schema = pa.schema(
        [("path", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            {"path": path.as_py(), "record_id": r.record_id, "uri": r.uri, "page_id": r.page_id, "payload_bytes": len(r.payload), "payload_digest": r.digest}
            for batch in batches
            for path, content in zip(batch.column(0), batch.column(1), strict=True)
            for r in read_arc(content.as_py())
        )
        return in_batches(rows, schema, lambda _: 100)

    return arc_files.mapInArrow(scan, f"path string, {RECORD}")


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """path, record_id and its original, for every record whose payload another record keeps.

    Of equal payloads of at least ``min_bytes`` the record with the largest page_id
    stays (null last, then the largest record id).
    """
    large = index.where(F.col("payload_bytes") >= min_bytes).withColumn(
        "payload", F.concat_ws(":", "payload_digest", F.col("payload_bytes").cast("string"))
    )
    groups = large.groupBy("payload").agg(F.max(F.struct("page_id", "record_id")).alias("original"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups.where("copies > 1"), "equal-payloads")
    joined = join_groups(large.select("path", "record_id", "payload"), groups, "payload", "copies")
    return joined.where(F.col("original").isNotNull() & (F.col("record_id") != F.col("original.record_id"))).select("path", "record_id", "original")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes the WARC twin of all ARC files below ``arc_path``.

    The revisits go to the archives, not the archives to the revisits: as many files as
    have ``revisit_bytes`` of them are converted at a time, against one broadcast.
    """
    index = materialize(arc_index(files(spark, arc_path)), "arc-index")
    listed = materialize(revisits(index, min_bytes), "revisits")
    sizes = {r["path"]: r["count"] for r in listed.groupBy("path").count().collect()}  # a row per archive
    turns: list[list[str]] = [[]]
    room = revisit_bytes
    for path in sorted(r[0] for r in index.select("path").distinct().collect()):
        cost = sizes.get(path, 0) * ONE_REVISIT
        if turns[-1] and cost > room:
            turns.append([])
            room = revisit_bytes
        turns[-1].append(path)
        room -= cost
    for turn, paths in enumerate(turns):
        whole = len(turns) == 1
        own = listed if whole else listed.join(F.broadcast(spark.createDataFrame([(p,) for p in paths], "path string")), "path")
        found = files(spark, arc_path) if whole else spark.read.format("binaryFile").load(paths).select("path", "content")
        _convert_files(found, own, f"{warc_path}/turn={turn}", archive_bytes)


def _convert_files(found: DataFrame, listed: DataFrame, path: str, archive_bytes: int) -> None:
    """The WARC twins of some archives, whose revisits (about REVISIT_BYTES) every executor gets."""
    by_file: dict[str, dict[str, dict]] = {}
    for r in listed.collect():
        by_file.setdefault(r["path"], {})[r["record_id"]] = r["original"].asDict()
    shared = found.sparkSession.sparkContext.broadcast(by_file)

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Callable[[int], bytes]]:
            for batch in batches:
                for file, content in zip(batch.column(0), batch.column(1), strict=True):
                    original = shared.value.get(file.as_py(), {})
                    for r in read_arc(content.as_py()):
                        made = warc_record(r, original.get(r.record_id))
                        yield lambda _, made=made: made

        yield from archives(records(), archive_bytes, end=b"\r\n\r\n")

    write_archives(found.mapInArrow(converted, "value binary"), path, "\r\n\r\n")
    shared.destroy()


def warc_table(spark: SparkSession, warc_path: str) -> DataFrame:
    """One row per WARC record; the digest and length of each stored payload are worked out anew and must agree."""
    names = [("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64())]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for content in batch.column(1):
                    for h, block in read_warc(content.as_py()):
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(h["warc-payload-length"])
                        if h["warc-type"] != "revisit":
                            payload = block[block.find(b"\r\n\r\n") + 4 :] if h["warc-type"] == "response" else block
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                        yield {
                            "record_type": h["warc-type"],
                            "record_id": h["warc-record-id"],
                            "uri": h["warc-target-uri"],
                            "date": h["warc-date"],
                            "page_id": number(h.get("warc-page-id")),
                            "payload_bytes": size,
                            "payload_digest": digest,
                            "refers_to_record": h.get("warc-refers-to"),
                            "refers_to": number(h.get("warc-refers-to-page-id")),
                        }

        return in_batches(rows(), pa.schema(names), lambda _: 200)

    types = "record_type string, record_id string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_record string, refers_to long"
    return files(spark, warc_path).mapInArrow(scan, types)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages as ARC, converts them to WARC, and reads the WARC back: one row per input row.

    Repeated rows become records of their own, of which one is the response. The
    columns are those of the records: what else a page row has is not archived, so
    names cannot clash. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc_path, warc_path = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc_path, archive_bytes=archive_bytes)
    convert(spark, arc_path, warc_path, min_bytes, archive_bytes, revisit_bytes)
    return warc_table(spark, warc_path)
