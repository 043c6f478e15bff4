"""WARC records in ZIP packages: writing, and reading back by range without extraction.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip
member per WARC record, and ``indexes/index.cdxj``, one line per record with offset
and length. The reader finds the directory at the end of the package (also a ZIP64
one), locates the stored members, reads the index and then only the byte ranges of
the records it wants; index lines, not packages, are dealt to tasks, so one large
package is read by many.

Equal payloads of at least ``min_bytes`` are written once: the record of the largest
page id is the response, the others are revisits that name it. Which payloads are
equal is decided on digests, without moving texts.

A package's name is unique to the task attempt that wrote it, and only packages of
committed attempts are in the manifest table, so retried and speculative tasks leave
no records twice. Files go through pyarrow's file systems by URI, into the shared folder.

Defined cases: a null payload is empty; a null url is left out of the record; null
page ids come last among equals and are read back as null; rows that share a page id
and payload are all responses if that id is the largest of its group; an empty table
gives no packages and no records. Other columns are ignored. A truncated package, a
compressed member and, unless asked otherwise, a record whose payload doesn't have
the digest it states are errors.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import joined_by_size, scratch_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MAX_PACKAGE = 256 << 20
#: Index lines of so many consecutive bytes of a package are read by one task.
SPLIT = 16 << 20
#: Reading tasks at most; beyond, each gets more bytes.
MOST_TASKS = 50_000
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


class Sink:
    """What zipfile needs of an output stream that can't seek."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.at = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, is_revisit: bool) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if is_revisit else head + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")))
    if is_revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of one uncompressed WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def decided(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with digest, size, refers_to and is_revisit."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1").drop("n"), "payloads")
    out = joined_by_size(rows, groups, ["digest", "size"], groups.count(), "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("is_revisit", is_revisit).withColumn("refers_to", F.when(is_revisit, F.col("first"))).drop("first")


def write_packages(pages: DataFrame, path: str, min_bytes: int = 1000) -> DataFrame:
    """Write all pages below ``path`` (a URI); the manifest (package, size, records) of what was committed."""
    rows = decided(pages, min_bytes).select("page_id", "url", "html", "digest", "size", "refers_to", "is_revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        rest = (dict(zip(batch.schema.names, row, strict=True)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rest, None)
        while row is not None:
            name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
            index, offset = [], 0
            with system.open_output_stream(f"{folder}/{name}") as stream:
                sink = Sink(stream)
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                    with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                        while row is not None and offset < MAX_PACKAGE:
                            raw = record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["size"], row["refers_to"], row["is_revisit"])
                            data = gzip.compress(raw, 6, mtime=0)
                            member.write(data)
                            index.append(json.dumps({"id": record_name(row["page_id"]), "offset": offset, "length": len(data)}))
                            offset += len(data)
                            row = next(rest, None)
                    package.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in index))
                size = sink.at
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size], pa.int64()), pa.array([len(index)], pa.int64())], ["package", "size", "records"])

    return written(rows.mapInArrow(write, "package string, size long, records long"), "manifest")


def directory(file: pa.NativeFile, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, stored size, offset of its local header), from the central directory."""
    tail_at = max(0, size - 65_557 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<H2I", tail[at + 10:at + 20])
    if at >= 20 and tail[at - 20:at - 16] == LOCATOR64:
        file.seek(struct.unpack("<Q", tail[at - 12:at - 4])[0])
        end64 = file.read(56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<3Q", end64[32:56])
    file.seek(start)
    raw, found, pos = file.read(length), {}, 0
    for _ in range(count):
        if raw[pos:pos + 4] != ENTRY:
            raise ValueError("bad directory entry")
        flags, method = struct.unpack("<2H", raw[pos + 8:pos + 12])
        packed, full = struct.unpack("<2I", raw[pos + 20:pos + 28])
        n, m, k = struct.unpack("<3H", raw[pos + 28:pos + 34])
        local = struct.unpack("<I", raw[pos + 42:pos + 46])[0]
        name = raw[pos + 46:pos + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[pos + 46 + n:pos + 46 + n + m], 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack("<2H", extra[e:e + 4])
            if kind == 1:  # the 64-bit values of those fields that hold all ones, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[e + 4:e + 4 + width // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            e += 4 + width
        found[name] = (method, packed, local)
        pos += 46 + n + m + k
    return found


def stored_range(file: pa.NativeFile, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where the bytes of a stored member lie."""
    method, size, local = member
    if method:
        raise ValueError("the member is compressed; only stored members can be read by range")
    file.seek(local)
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError("bad local header")
    n, m = struct.unpack("<2H", head[26:30])
    return local + 30 + n + m, size


def index_lines(packages: DataFrame) -> DataFrame:
    """(package, offset, length) of every record; offsets count from the start of the package."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                system, path = opened(package)
                with system.open_input_file(path) as file:
                    members = directory(file, file.size())
                    base, _ = stored_range(file, members[DATA])
                    start, size = stored_range(file, members[INDEX])
                    rest, done = b"", 0
                    while done < size:
                        file.seek(start + done)
                        chunk = file.read(min(4 << 20, size - done))
                        done += len(chunk)
                        *lines, rest = (rest + chunk).split(b"\n")
                        found = [json.loads(x) for x in lines if x]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([package] * len(found), pa.string()), pa.array([base + x["offset"] for x in found], pa.int64()), pa.array([x["length"] for x in found], pa.int64())],
                            ["package", "offset", "length"],
                        )

    return packages.select("package").mapInArrow(read, "package string, offset long, length long")


def read_records(packages: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of the packages named in column ``package``, whose bytes are in column ``size``.

    With ``strict`` a damaged record is an error, else its ``intact`` is false.
    """
    n_bytes = packages.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Lines are small and records are not: the number of tasks comes from the bytes behind the lines.
    tasks = min(MOST_TASKS, max(1, -(-n_bytes // SPLIT), min(packages.sparkSession.sparkContext.defaultParallelism, n_bytes >> 20)))
    split = -(-n_bytes // (4 * tasks)) or 1  # four stretches a task, to even out
    ranges = index_lines(packages).withColumn("_split", F.floor(F.col("offset") / split))
    ranges = ranges.repartition(tasks, "package", "_split").sortWithinPartitions("package", "offset").drop("_split")
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            rows = []
            for package, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package != at:
                    system, path = opened(package)
                    if file:
                        file.close()
                    at, file = package, system.open_input_file(path)
                fields, _, payload = parsed(zlib.decompress(file.read_at(length, offset), 31))
                digest = fields["warc-payload-digest"].partition(":")[2]
                revisit = fields["warc-type"] == "revisit"
                full = int(_.rpartition(b"Content-Length:")[2]) if revisit else len(payload)
                actual = digest if revisit else hashlib.sha1(payload).hexdigest()
                refers_to = page_of(fields["warc-refers-to"]) if revisit else None
                if strict and actual != digest:
                    raise ValueError(f"{package}: the record at byte {offset} is damaged")
                row = (page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], full, actual, refers_to, actual == digest)
                rows.append((*row, None if revisit else payload) if with_payload else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)
        if file:
            file.close()

    return ranges.mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, min_bytes: int = 1000, with_payload: bool = False) -> DataFrame:
    """Write the pages to the shared folder and read all records back."""
    manifest = write_packages(pages, scratch_path(pages.sparkSession, "warc"), min_bytes)
    return read_records(manifest, with_payload)
