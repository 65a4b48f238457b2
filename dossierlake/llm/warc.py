"""Legacy web archives: ARC to WARC conversion, WARC writing and reading.

ARC files of either version state their own record header fields in the first block; records are cut by declared
lengths.  Each becomes a WARC record with an identifier, timestamp, type and digests made from it.  Spark's text
writer writes the records (a record ends in CR LF CR LF, whose last byte is the writer's line end), so files go through
its commit protocol into any store; files are read as bytes, a task each, and parsed as a stream.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from base64 import b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.scratch import scratch_path
from dossierlake.llm.common import drop_written, written

#: record header fields of the two ARC versions (fixed values)
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_DATE = "20240101000000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------------------------------


def arc_record(fields: dict[str, str], block: bytes, version: str) -> bytes:
    line = " ".join(str(len(block)) if f == "Archive-length" else re.sub(r"\s", "%20", fields.get(f) or "-") for f in ARC_FIELDS[version].split(" "))
    return line.encode("utf-8", "surrogateescape") + b"\n" + block + b"\n"


def arc_head(name: str, version: str) -> bytes:
    """The version block that begins a file: version, origin, and the header fields of its records."""
    return arc_record({"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": ARC_DATE, "Content-type": "text/plain"}, f"{version} 0 origin\n{ARC_FIELDS[version]}\n".encode(), version)


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an ARC file, gzipped or not.

    Header lines are read by the fields that the version block names; a URL with stray spaces keeps them, since the
    other fields are counted from the right.  A declared length beyond the file is an error.
    """
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    names: list[str] | None = None
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        length = int(parts[-1])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"ARC record of {length} bytes is cut off after {len(block)}")
        if names is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            head = block.decode("utf-8", "replace").split("\n")
            version = head[0].split(" ")[0]
            names = head[1].split(" ") if len(head) > 1 and head[1].startswith("URL ") else ARC_FIELDS[version].split(" ")
            continue
        rest = parts[len(parts) - len(names) + 1 :]
        yield dict(zip(names, [" ".join(parts[: len(parts) - len(names) + 1]), *rest], strict=True)), block


def pages_to_arc(pages: DataFrame, archive_bytes: int = 8_000_000, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """ARC files (path, content) that hold a record per page, versions 1 and 2 in turn, of about archive_bytes each.

    The payload is the page's text in UTF-8 (null: empty) behind an HTTP header that carries the page's id; a null
    URL becomes urn:page:<id>.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, count, out, size = uuid.uuid4().hex, 0, [], 0

        def close() -> pa.RecordBatch:
            version = "12"[count % 2]
            name = f"{tag}-{count}.arc"
            content = arc_head(name, version) + b"".join(arc_record(f, b, version) for f, b in out)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for i, u, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                page, body = i.as_py(), (t.as_py() or "").encode("utf-8", "surrogateescape")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n"
                fields = {"URL": u.as_py() or f"urn:page:{page}", "IP-address": "0.0.0.0", "Archive-date": ARC_DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": sha1_base32(body)}
                out.append((fields, head.encode() + body))
                size += len(body) + 400
                if size >= archive_bytes:
                    yield close()
                    count, out, size = count + 1, [], 0
        if out:
            yield close()

    return pages.select(F.col(id_col).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, "path string, content binary")


# --- conversion --------------------------------------------------------------------------------------------------

CAPTURES = "page_id long, record_id string, uri string, date string, ip string, media string, digest string, payload_bytes long, http string, payload binary"


def arc_to_captures(archives: DataFrame) -> DataFrame:
    """One row per ARC record: what a WARC record of it needs, with identifier, ISO timestamp and digest synthesised.

    The identifier is a name-based UUID of URI, date, page and digest, so a run that is repeated gives the same.  A
    block without an HTTP header is all payload.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = [(n, pa.string()) for n in ("record_id", "uri", "date", "ip", "media", "digest")]
        schema = pa.schema([("page_id", pa.int64()), *text, ("payload_bytes", pa.int64()), ("http", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in parse_arc(content.as_py()):
                    head, found, payload = block.partition(b"\r\n\r\n")
                    if not found or not head.startswith(b"HTTP/"):
                        head, payload = b"", block
                    page = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
                    d = f["Archive-date"].ljust(14, "0")
                    digest = sha1_base32(payload)
                    name = f"{f['URL']}|{d}|{page and page[1].decode()}|{digest}"
                    rows.append({
                        "page_id": int(page[1]) if page else None,
                        "record_id": f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode('utf-8', 'surrogateescape')).digest()[:16], version=5)}>",
                        "uri": f["URL"], "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "ip": f["IP-address"], "media": f["Content-type"],
                        "digest": digest, "payload_bytes": len(payload), "http": head.decode("utf-8", "replace"), "payload": payload,
                    })
                    size += len(payload)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("content").mapInArrow(run, CAPTURES)


def mark_revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """captures plus type and refers_to: of equal payloads of at least min_bytes the smallest page is the response.

    Rows that share that page id are all responses; where a payload has no page id at all, each row is a response.
    Only digests that occur more than once are joined back, small tables by broadcast, large ones by a shuffle whose
    hot digests adaptive execution splits.
    """
    known = captures.where(F.col("payload_bytes") >= min_bytes)
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))
    first = known.groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = written(first.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record")), "payloads")
    marked = captures.join(repeats, "digest", "left")
    again = F.col("first_page").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return marked.withColumn("type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_page")))


#: Records, and bytes of payload, of a WARC file at most
FILE_RECORDS, FILE_BYTES = 5_000, 1 << 30


def write_warc(marked: DataFrame, path: str, largest: int = 0) -> None:
    """Write captures as gzipped WARC 1.1 files into a folder; a revisit holds the HTTP header alone.

    largest: bytes of the largest payload, from which follows how many records a file may hold, so that a task can read
    a whole file.  Spark's text writer makes one gzip member of a file.
    """
    records_per_file = max(1, min(FILE_RECORDS, FILE_BYTES // max(largest, 1)))
    revisit = F.col("type") == "revisit"
    http = F.when(F.col("http") == "", "").otherwise(F.concat("http", F.lit("\r\n\r\n")))
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    block = F.concat(http.cast("binary"), body)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.col("first_record")), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string"))
        )).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.when(F.col("http") == "", F.col("media")).otherwise(F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("block"), F.lit("\r\n\r").cast("binary"))
    marked.withColumn("block", block).select(record.cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each WARC record, cut by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"WARC record of {length} bytes is cut off after {len(block)}")
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder of WARC files: (page_id, payload_bytes, payload_digest, record_type, refers_to, uri, record_id).

    Digests of responses are computed from the payloads and must equal the declared ones; those of revisits are the
    declared ones, with the length of the payload that they stand for.  An empty folder gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "record_id"]
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                rows = []
                for h, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)):
                    head, found, payload = block.partition(b"\r\n\r\n")
                    if not found or not head.startswith(b"HTTP/"):
                        head, payload = b"", block
                    page = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
                    digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    if h["warc-type"] == "response" and (sha1_base32(payload), len(payload)) != (digest, size):
                        raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                    refers = h.get("x-refers-to-page-id")
                    values = [int(page[1]) if page else None, size, digest, h["warc-type"], int(refers) if refers else None, h.get("warc-target-uri"), h["warc-record-id"]]
                    rows.append(dict(zip(names, values, strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, record_id string"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, kind)


def convert(archives: DataFrame, path: str, min_bytes: int = 0, largest: int = 0) -> None:
    """ARC files (path, content) to WARC files in a folder, equal payloads as revisits of the first.

    Captures are written once: digests are counted from their small columns, records made from all, and no archive is
    parsed twice.
    """
    captures = written(arc_to_captures(archives), "captures")
    write_warc(mark_revisits(captures, min_bytes), path, largest)
    drop_written(captures)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Pages to ARC, converted to WARC in the shared folder, and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    convert(pages_to_arc(pages), path, largest=largest)
    return read_warc(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
