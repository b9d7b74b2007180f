"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Writing: equal payloads of ``REVISIT_BYTES`` or more are stored once, by the page with the smallest id; the others
become revisit records that name it. Every task writes files of its own under a name no other attempt uses and
returns their names as rows. The list of names is written as a table, and only listed files are read, so a task that
fails or runs twice leaves nothing behind that counts.

Reading: a file is read in chunks of fixed size; each gzip member is inflated as it comes, the record's header is
parsed, exactly ``Content-Length`` bytes of block are framed and both digests are verified. A file's memory is that of its
largest record. A wrong length, digest or ending raises an error that names file and record.

Null pages have an empty payload. Several rows with a payload's smallest id are all responses. A page with a null id is
a response only if all pages of its payload have none.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import common, storage
from cohortloom.session import cut_lineage, shared_folder

REVISIT_BYTES = 100
CHUNK = 1 << 18
#: A file is closed once it is so long; the next record opens another.
FILE_BYTES = 1 << 29
#: Records carry no clock time, so that a task that runs again writes the same bytes.
DATE = "1970-01-01T00:00:00Z"


@dataclass
class Record:
    header: dict[str, str]
    block: bytes


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as one gzip member; a revisit has an empty block and the digest and size of the full payload."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def read_records(stream, name: str = "") -> Iterator[Record]:
    """Records of one archive in order, from an open binary stream."""
    pending = stream.read(CHUNK)
    number = 0
    while pending:
        member = zlib.decompressobj(31)
        parts = []
        while not member.eof:
            if not pending:
                raise ValueError(f"{name}: record {number} is cut off")
            parts.append(member.decompress(pending))
            pending = member.unused_data if member.eof else stream.read(CHUNK)
        if not pending:
            pending = stream.read(CHUNK)
        yield framed(b"".join(parts), f"{name}: record {number}")
        number += 1


def framed(raw: bytes, what: str) -> Record:
    """Header and block of an inflated record, its length and digests verified."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.1\r\n") or end < 0:
        raise ValueError(f"{what} has no header")
    header = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    size = int(header["Content-Length"])
    block, rest = raw[end + 4:end + 4 + size], raw[end + 4 + size:]
    if len(block) != size or rest != b"\r\n\r\n":
        raise ValueError(f"{what} does not have the length it names")
    found = f"sha256:{hashlib.sha256(block).hexdigest()}"
    if found != header["WARC-Block-Digest"] or (
            header["WARC-Type"] == "response" and found != header["WARC-Payload-Digest"]):
        raise ValueError(f"{what} does not have the digest it names")
    return Record(header, block)


def planned(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """(id, url, html, bytes, digest, refers_to) of every page."""
    html = F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), html.alias("html")).select(
        "*", F.octet_length("html").cast("bigint").alias("bytes"), F.sha2("html", 256).alias("digest"))
    repeated = cut_lineage(
        rows.where(F.col("bytes") >= REVISIT_BYTES).select("id", "digest").groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    with_first = common.join_groups(rows, repeated, "digest", "copies", F.col("url"))
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return with_first.select("id", "url", "html", "bytes", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url",
                   html_column: str = "html") -> DataFrame:
    """Write one record per page below ``folder``; the table (file, records, bytes) lists the files."""
    storage.make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[tuple[str, int, int]] = []
        out, name, records, length = None, "", 0, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        name, records, length = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = storage.writer(name)
                    is_revisit = row["refers_to"] is not None
                    data = record_bytes(row["id"], _one_line(row["url"]), b"" if is_revisit else row["html"],
                                        row["digest"], row["bytes"], row["refers_to"])
                    out.write(data)
                    records, length = records + 1, length + len(data)
                    if length >= FILE_BYTES:
                        out.close()
                        files.append((name, records, length))
                        out = None
            if out is not None:
                out.close()
                files.append((name, records, length))
                out = None
        finally:
            if out is not None:
                out.close()
        if files:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*files)], names=["file", "records", "bytes"])

    plan = planned(pages, id_column, url_column, html_column)
    return cut_lineage(plan.mapInArrow(write, "file string, records bigint, bytes bigint"))


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split())


READ = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType())])


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of the listed archives; a file that holds other than its listed records is an error."""

    def number(urn: str | None) -> int | None:
        inner = urn[len("<urn:page:"):-1] if urn else ""
        return int(inner) if inner else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size, seen = [], 0, 0
                with storage.reader(row["file"]) as stream:
                    for record in read_records(stream, row["file"]):
                        h = record.header
                        held.append((row["file"], number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"],
                                     int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"),
                                     number(h.get("WARC-Refers-To")), record.block if payload else None))
                        size, seen = size + len(record.block) * payload + 300, seen + 1
                        if size > 1 << 23:
                            yield _rows(held)
                            held, size = [], 0
                if seen != row["records"]:
                    raise ValueError(f"{row['file']} holds {seen} records, not {row['records']}")
                if held:
                    yield _rows(held)

    n = max(1, files.count())
    return files.select("file", "records").repartitionByRange(n, "file").mapInArrow(read, READ)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*held), types)], names=READ.fieldNames())


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
               folder: str | None = None) -> DataFrame:
    """Write the pages' archives to the folder (default: a new one in the shared folder) and read them back."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, id_column, url_column, html_column), payload=False)
