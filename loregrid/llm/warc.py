"""WARC records in ZIP packages, written and read in parallel.

A package holds stored (uncompressed) members: archive/data.warc.gz, each record a gzip member of its own, and indexes/index.cdxj, a line for each
record with its place. The reader parses the end record, the ZIP64 records and the central directory, finds where a stored member's bytes lie, and
range-reads runs of records from there; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, pick, sent, shared_dir, slices, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: The profile of revisit records, and the date that records bear where none is known.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def filesystem(uri: str):
    """(Arrow file system, path) of a URI or local path."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


@dataclass
class Record:
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload: bytes | None  # of a response
    payload_bytes: int
    payload_digest: str


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    text = name.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def to_warc(r: Record) -> bytes:
    """A record as WARC/1.1. A revisit's block is the HTTP header alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload or b"") if r.record_type == "response" else http
    url = r.url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: {_name(r.page_id)}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{r.payload_digest}"]
    if r.record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(r.refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def from_warc(data: bytes) -> Record:
    """The record that data holds; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    http, _, body = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    sha, response = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "response"
    if response and (digest(body) != sha or len(body) != size):
        raise ValueError("a payload differs from its digest")
    return Record(_id(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _id(h["warc-refers-to"]) if "warc-refers-to" in h else None, body if response else None, size, sha)


# ---------------------------------------------------------------- packages


class PackageWriter:
    """Writes records to one package, as a stream."""

    def __init__(self, uri: str, level: int = 6):
        system, path = filesystem(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.level, self.out = uri, level, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.at, self.index = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []

    def add(self, r: Record) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = z.compress(to_warc(r)) + z.flush()
        self.member.write(data)
        self.index.append(json.dumps({"page_id": r.page_id, "offset": self.at, "length": len(data), "digest": r.payload_digest}))
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("".join(f"{x}\n" for x in self.index).encode())
        self.zip.close()
        self.out.close()


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class PackageReader:
    """A ZIP package's directory, and ranges of its stored members. file: random access (seek, read)."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the package ends early")
        return data

    def _directory(self):
        tail_at = max(0, self.size - 65_557)  # the end record and the longest comment
        tail = self._read(tail_at, self.size - tail_at)
        i = tail.rfind(b"PK\x05\x06")
        while i >= 0 and (len(tail) < i + 22 or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
            i = tail.rfind(b"PK\x05\x06", 0, i)
        if i < 0:
            raise ValueError("no end record: not a ZIP package")
        count, length, start = struct.unpack_from("<HII", tail, i + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            where = tail_at + i - 20
            mark, _, end_at, _ = struct.unpack("<4sIQI", self._read(where, 20)) if where >= 0 else (b"", 0, 0, 0)
            if mark == b"PK\x06\x07":
                end = self._read(end_at, 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end record where its locator points")
                count, length, start = struct.unpack_from("<QQQ", end, 32)
        data, at = self._read(start, length), 0
        for _ in range(count):
            mark, _, _, _, method, _, _, _, packed, size, n, extra, comment, _, _, _, header = struct.unpack_from("<4s6H3I5H2I", data, at)
            if mark != b"PK\x01\x02":
                raise ValueError("the central directory is broken")
            name = data[at + 46 : at + 46 + n].decode("utf-8")
            more, j = data[at + 46 + n : at + 46 + n + extra], 0
            while j + 4 <= len(more):
                kind, m = struct.unpack_from("<HH", more, j)
                if kind == 1:  # ZIP64: only what is all ones outside, in this order
                    k = j + 4
                    if size == 0xFFFFFFFF:
                        size, k = struct.unpack_from("<Q", more, k)[0], k + 8
                    if packed == 0xFFFFFFFF:
                        packed, k = struct.unpack_from("<Q", more, k)[0], k + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", more, k)[0]
                j += 4 + m
            yield Member(name, method, size, header)
            at += 46 + n + extra + comment

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes start in the package, and how many they are."""
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed: it has no ranges")
        mark, n, extra = struct.unpack("<4s22xHH", self._read(m.header, 30))
        if mark != b"PK\x03\x04":
            raise ValueError("no local header where the directory points")
        return m.header + 30 + n + extra, m.size

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        at, size = self.place(name)
        return self._read(at + start, size - start if length is None else min(length, size - start))


def records(data: bytes, sizes: list[int]):
    """The records of a run of gzip members of these sizes."""
    at = 0
    for size in sizes:
        yield from_warc(zlib.decompress(data[at : at + size], 31))
        at += size


# ---------------------------------------------------------------- tables


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses): of equal payloads (by SHA-256 and size) of at least least_bytes bytes, those with the smallest page_id are responses.

    A null page_id comes after all others: its record revisits one that has an id, or is a response where none has.
    """
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("sha"), F.length("payload").alias("size"))
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("many"))
    first = stored(first.where("many > 1").drop("many"), "first")  # alone, a payload has nothing to revisit; both sides of the join are plain, so a large group is split
    joined = rows.join(sent(first), ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _write(top: str, most: int):
    def run(batches):
        writer, count = None, 0

        def done():
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([writer.uri]), pa.array([count], pa.int64())], names=["package", "n_records"])

        for whole in batches:
            for batch in slices(whole, "payload"):
                for i, url, payload, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]):
                    if writer is None:
                        writer, count = PackageWriter(f"{top}/{uuid.uuid4().hex}.zip"), 0
                    writer.add(Record(i, url, "response" if first is None else "revisit", first, payload, len(payload), digest(payload)))
                    count += 1
                    if writer.at >= most:
                        yield done()
                        writer = None
        if writer is not None:
            yield done()

    return run


def write_packages(pages: DataFrame, top: str, least_bytes: int = 0, package_mb: int = 512) -> DataFrame:
    """Writes a record for each page (null html: an empty payload; null url: an empty one) to packages below top; returns package, n_records.

    A task that runs again writes packages of its own; only those of the run that counts are in the result, which is written down and read from there.
    """
    return stored(roles(pages, least_bytes).mapInArrow(_write(top, package_mb << 20), "package string, n_records long"), "manifest")


def _locate(most: int):
    def run(batches):
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                system, path = filesystem(uri)
                with system.open_input_file(path) as f:
                    reader = PackageReader(f, f.size())
                    at, _ = reader.place(DATA)
                    rows, start, length, sizes = [], 0, 0, []
                    for line in reader.read(INDEX).decode().splitlines():
                        sizes.append(json.loads(line)["length"])
                        length += sizes[-1]
                        if length >= most:
                            rows.append((uri, at + start, sizes))
                            start, length, sizes = start + length, 0, []
                    if sizes:
                        rows.append((uri, at + start, sizes))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["package", "start", "sizes"])

    return run


_COLUMNS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]


def _ranges(batches):
    names = [x.split()[0] for x in _COLUMNS.split(", ")]
    for batch in batches:
        for uri, start, sizes in zip(*[batch.column(c).to_pylist() for c in ("package", "start", "sizes")]):
            system, path = filesystem(uri)
            with system.open_input_file(path) as f:
                f.seek(start)
                rows = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload, r.payload_bytes, r.payload_digest) for r in records(f.read(sum(sizes)), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=names)


def read_packages(packages: DataFrame, run_mb: int = 2) -> DataFrame:
    """The records of packages (a column package of URIs), read in runs of about run_mb: page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest."""
    runs = packages.select("package").repartition(parts(packages)).mapInArrow(_locate(run_mb << 20), "package string, start long, sizes array<long>")
    return runs.repartition(parts(packages), "package", "start").mapInArrow(_ranges, _COLUMNS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Every page written to packages in the shared folder and read back. Empty tables give no rows; rows that repeat a page_id are records each."""
    spark: SparkSession = pages.sparkSession
    return read_packages(write_packages(pages, f"{shared_dir(spark)}/packages", least_bytes))
