"""WARC archives in ZIP packages: written by tasks, range-read without extraction.

Each writing task streams its rows into packages of about ``PACKAGE`` bytes in
the shared folder. A package holds two stored members: ``archive/data.warc.gz``,
in which every record is a gzip member of its own, and ``indexes/index.jsonl``
with the offset and length of each record. A package counts only if the task's
result lists it, so a lost or repeated attempt leaves nothing that is read.

The reader opens a package at its end, parses the end record, the ZIP64 end
record and the central directory with its ZIP64 fields, finds where a stored
member's bytes begin, reads the index, and then reads the records by ranges of
up to ``RANGE`` neighbouring bytes. Nothing is unpacked to a disk.

Payloads of at least ``LEAST`` bytes that are equal (by SHA-1 and length) share
one response record, that of the largest page_id; the others are revisit
records without a payload, which the reader resolves through the response.

Defined results: a null html is an empty payload; a null url is written as
``urn:page:<id>``; repeated rows of a response's page_id and payload are responses
all, and a page_id may have several payloads; a
null page_id never is the one that others refer to; an empty table gives no
rows and no packages. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, fresh_dir

#: Payload bytes from which equal payloads are written once.
LEAST = 1000
PACKAGE, RANGE = 64 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"

# --- records ----------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    name = "null" if page_id is None else str(page_id)
    target = _clean(url) if url else f"urn:page:{name}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# --- packages ---------------------------------------------------------------------


class Package:
    """The directory of a ZIP file that is read by ranges.

    ``read_at(offset, length)`` gives bytes of the file and ``size`` its length.
    """

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - (1 << 16) - 22)
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<10xHII", tail[end : end + 20])
        locator = tail_at + end - 20
        if locator >= 0 and read_at(locator, 4) == b"PK\x06\x07":
            (at,) = struct.unpack("<8xQ", read_at(locator, 16))
            wide = read_at(at, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, length, start = struct.unpack("<32xQQQ", wide)
        self.members = self._members(read_at(start, length), count)

    @staticmethod
    def _members(raw: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """Name to (method, stored size, local header offset)."""
        out, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("central directory entry expected")
            method, stored, plain, n, extra, comment, local = struct.unpack("<10xH8xIIHHH8xI", raw[at : at + 46])
            name = raw[at + 46 : at + 46 + n].decode("utf-8")
            fields, k = raw[at + 46 + n : at + 46 + n + extra], 0
            while k + 4 <= len(fields):
                kind, width = struct.unpack("<HH", fields[k : k + 4])
                if kind == 1:  # ZIP64: only the values that overflowed, in this order
                    wide = iter(struct.unpack(f"<{width // 8}Q", fields[k + 4 : k + 4 + width // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    stored = next(wide) if stored == 0xFFFFFFFF else stored
                    local = next(wide) if local == 0xFFFFFFFF else local
                k += 4 + width
            out[name] = (method, stored, local)
            at += 46 + n + extra + comment
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the file."""
        method, length, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        n, extra = struct.unpack("<4s22xHH", self.read_at(local, 30))[1:]
        return local + 30 + n + extra, length


def open_package(uri: str):
    """(Package, file) over any store that Arrow can reach."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)

    def read_at(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return Package(read_at, file.size()), file


def read_index(package: Package) -> list[dict]:
    """The index member's entries."""
    at, length = package.stored(INDEX)
    return [json.loads(line) for line in package.read_at(at, length).splitlines()]


def read_records(package: Package, entries: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of index entries; neighbours are read in one range."""
    begin, _ = package.stored(DATA)
    entries = sorted(entries, key=lambda e: e["offset"])
    i = 0
    while i < len(entries):
        first, j, stop = entries[i]["offset"], i, entries[i]["offset"]
        while j < len(entries) and entries[j]["offset"] - stop < 4096 and entries[j]["offset"] + entries[j]["length"] - first <= max(RANGE, entries[i]["length"]):
            stop = entries[j]["offset"] + entries[j]["length"]
            j += 1
        held = package.read_at(begin + first, stop - first)
        for e in entries[i:j]:
            yield parse_record(zlib.decompress(held[e["offset"] - first : e["offset"] - first + e["length"]], 31))
        i = j


class _Writer:
    """One package, streamed to the shared folder."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index = io.StringIO()
        self.at = self.n = 0

    def add(self, page_id, raw: bytes) -> None:
        packed = gzip.compress(raw, 3, mtime=0)
        self.data.write(packed)
        self.index.write(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}) + "\n")
        self.at += len(packed)
        self.n += 1

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()
        self.stream.close()
        return self.uri, self.n


# --- Spark ------------------------------------------------------------------------


def plan(pages: DataFrame) -> DataFrame:
    """``pages`` as (page_id, url, payload, digest, refers_to)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = cut(groups.where("n > 1 AND first IS NOT NULL").select("digest", "size", "first"), "warc-shared")
    joined = rows.join(shared, ["digest", "size"], "left")
    other = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a Spark schema."""
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write packages below ``folder``; (package, n_records) of those that count."""
    names = ("page_id", "url", "payload", "digest", "refers_to")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in names)):
                out = out or _Writer(folder)
                out.add(page_id, record(page_id, url, payload, digest, refers_to))
                if out.at >= PACKAGE:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        yield _batch(done, PACKAGES)

    return cut(planned.mapInArrow(stream, PACKAGES), "warc-packages")


#: Rows pass between Spark and Python as Arrow lists, in which a null beside a
#: 64-bit number leaves it a whole number.
_TYPES = {"long": pa.int64(), "string": pa.string()}
PACKAGES = "package string, n_records long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, target string"


def read(packages: DataFrame) -> DataFrame:
    """The records of all packages, with size and SHA-1 of the payload read.

    Packages are dealt out one by one, whatever files their list came from.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if v in (None, "null") else int(v)
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                package, file = open_package(uri)
                rows = []
                with file:
                    for headers, payload in read_records(package, read_index(package)):
                        page = headers["warc-record-id"][len("<urn:page:") : -1]
                        to = headers.get("warc-refers-to")
                        kind = headers["warc-type"]
                        digest = hashlib.sha1(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"][len("sha1:") :]
                        size = len(payload) if kind == "response" else None
                        rows.append((number(page), kind, number(to[len("<urn:page:") : -1]) if to else None, size, digest, headers["warc-target-uri"]))
                yield _batch(rows, RECORD)

    n = max(1, min(packages.count(), 20_000))
    return packages.select("package").repartition(n).mapInArrow(scan, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with the payload size of revisits taken from the response that they refer to.

    A revisit names its response's page and carries its digest; a page_id may stand for
    responses of several payloads, so both are compared.
    """
    known = cut(records, "warc-records")
    responses = known.where("record_type = 'response' AND page_id IS NOT NULL").groupBy("page_id", "payload_digest")
    responses = cut(responses.agg(F.max("payload_bytes").alias("_bytes")).withColumnsRenamed({"page_id": "_page", "payload_digest": "_digest"}), "warc-responses")
    same = (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    revisits = known.where("refers_to IS NOT NULL").join(responses, same, "left").withColumn("payload_bytes", F.col("_bytes"))
    return known.where("refers_to IS NULL").unionByName(revisits.select(*known.columns))


def query(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages, read them back; the contract's columns."""
    folder = fresh_dir(pages.sparkSession, "warc")
    records = resolve(read(write(plan(pages), folder)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
