"""Media columns: interleaved document sequences.

``sequences`` parses HTML into ordered items: stretches of text and references
to media, each with its position in the document and, for media, the caption of
its figure. References name their payload by digest (``sha256:<hex>``).

``store`` writes media to files of the shared folder, many to a file, and gives
a table of digest, file, offset and length. A file counts only if a finished
task lists it, so lost or repeated attempts leave nothing that is read.
``locate`` joins references to that table by digest, and ``assemble`` puts the
located references of each document in order of position and reads their bytes
by ranges that many neighbouring documents share. Media bytes are
written once and read once and never shuffled; only digests and places are.

Media are stored losslessly as 8-bit grey samples, 576 to a row, in PNG files of
their own; a payload is cut into several of them. ``encode_png`` and
``read_png`` are inverse.

Defined results: a null html has no items; text outside figures is one item
between two tags that break the flow; an image without a usable reference keeps
its place with a null digest; a caption belongs to the image before it in the
same figure; a digest that is not stored keeps its row with null media columns,
and a document that shows one has no payload; repeated rows give repeated
items; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, fresh_dir

WIDTH, BLOCK, TAIL = 576, 576, 32
#: Payload bytes of one image, and bytes of media after which a task begins another file.
PIECE, FILE = 4 * BLOCK, 64 << 20
#: Bytes of a range read along a file, and of media for each reading task.
RANGE, SHARE = 4 << 20, 16 << 20
ITEM = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
#: Tags that end a stretch of text, and those whose text is not shown.
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split()
)
HIDDEN = frozenset("script style head template noscript".split())


class _Items(HTMLParser):
    """Ordered items of one document."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split()) if self.text else ""
        self.text = []
        if text:
            self.items.append([len(self.items), "text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BREAKS:
            self._flush()
        if tag in ("img", "audio", "video"):
            self._flush()
            source = dict(attrs).get("src") or ""
            digest = source[7:].lower() if source.startswith("sha256:") else None
            self.figure = len(self.items)
            self.items.append([self.figure, "media", None, digest, dict(attrs).get("alt") or None])
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag == "figure":
            self.figure = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            if self.figure is not None and text:
                self.items[self.figure][4] = text
            elif text:
                self.items.append([len(self.items), "text", text, None, None])
            self.caption = None
        if tag in BREAKS:
            self._flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if self.hidden:
            return
        (self.text if self.caption is None else self.caption).append(data)


def parse_items(html: str | None) -> list[tuple]:
    """(pos, kind, text, digest, caption) in document order."""
    if not html:
        return []
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser._flush()
    return [tuple(i) for i in parser.items]


def sequences(docs: DataFrame, html: Column) -> DataFrame:
    """``docs`` with ``items``, the ordered text and media references of ``html``."""
    @F.pandas_udf(ITEM)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("pos", "kind", "text", "digest", "caption")
        for rows in batches:
            yield pd.Series([[dict(zip(names, i)) for i in parse_items(h)] for h in rows], dtype=object)

    return docs.withColumn("items", parse(html))


# --- samples ------------------------------------------------------------------------


def padded(data: Column) -> Column:
    """``data`` with bytes 255 appended up to a positive multiple of BLOCK."""
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(BLOCK))).cast("int")
    return F.rpad(data, blocks * BLOCK, F.lit(b"\xff"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    """Samples as an 8-bit grey PNG, WIDTH to a row; rows are not filtered."""
    height = len(samples) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> tuple[int, int, bytes]:
    """(width, height, samples) of a PNG that ``encode_png`` made."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts = 8, {}
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the PNG is damaged")
        parts[kind] = parts.get(kind, b"") + data
        at += 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or rows[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey PNG")
    return width, height, rows[:, 1:].tobytes()


def feature(width: int, height: int, bins: np.ndarray) -> str:
    """Shape, sum, sum of squares and a 16-bin histogram of counted samples, all exact."""
    value = np.arange(256)
    counts = bins.reshape(16, 16).sum(1)
    return f"{width}x{height};{int(bins @ value)};{int(bins @ value**2)};" + ",".join(map(str, counts.tolist()))


# --- the store ----------------------------------------------------------------------

#: ``file`` is the 16-byte name of a file of the store's folder; digests are raw bytes here.
PLACES = "digest binary, file binary, offset long, length int"


def _uri(folder: str, name: bytes) -> str:
    return f"{folder}/{bytes(name).hex()}.media"


class _File:
    """One file of media, streamed to the shared folder."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.name = uuid.uuid4().bytes
        store, path = fs.FileSystem.from_uri(_uri(folder, self.name))
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream, self.at = store.open_output_stream(path), 0

    def add(self, media: bytes) -> tuple[bytes, int, int]:
        self.stream.write(media)
        self.at += len(media)
        return self.name, self.at - len(media), len(media)


def store(payloads: DataFrame, folder: str) -> DataFrame:
    """Write the images of (pieces: array of payload bytes) below ``folder``; the table
    of PLACES, a row for each digest. A task writes a piece it has seen lately once."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, {}
        for batch in batches:
            rows = []
            for pieces in batch.column("pieces").to_pylist():
                for piece in pieces:
                    digest = hashlib.sha256(piece).digest()
                    if digest in seen:
                        continue
                    file = file or _File(folder)
                    rows.append((digest, *file.add(encode_png(piece))))
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[digest] = True
                    if file.at >= FILE:
                        file.stream.close()
                        file = None
            columns = list(zip(*rows)) if rows else [()] * 4
            types = (pa.binary(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["digest", "file", "offset", "length"])
        if file:
            file.stream.close()

    places = cut(payloads.select("pieces").mapInArrow(write, PLACES), "media-places")
    best = places.groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("at"))
    return cut(best.select("digest", "at.*"), "media-index")


def locate(refs: DataFrame, places: DataFrame) -> DataFrame:
    """References (``digest`` as raw bytes) with the places of the media they name; null if there are none."""
    return refs.join(places.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left").drop("_digest")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_positions string"


class _Reader:
    """Bytes of media files by ranges.

    A window of RANGE bytes moves forward along a file with the documents, whose
    first media come in order; media that lie elsewhere are read by themselves.
    """

    def __init__(self):
        self.uri = self.file = None
        self.at, self.window = 0, b""

    def _open(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        return store.open_input_file(path)

    def bytes_of(self, uri: str, offset: int, length: int, first: bool) -> bytes:
        end = self.at + len(self.window)
        if uri == self.uri and self.at <= offset <= offset + length <= end:
            return self.window[offset - self.at : offset - self.at + length]
        if not first and (uri != self.uri or not self.at <= offset < end + RANGE):
            with self._open(uri) as file:
                file.seek(offset)
                return file.read(length)
        if uri != self.uri:
            self.close()
            self.uri, self.file = uri, self._open(uri)
        self.file.seek(offset)
        self.at, self.window = offset, self.file.read(max(length, RANGE))
        return self.window[:length]

    def close(self) -> None:
        if self.file:
            self.file.close()


def _read_back(reader: _Reader, folder: str, items: list[dict]) -> tuple:
    """The values of READ of a document's located items, in order of position."""
    whole, form, media_bytes, tail = hashlib.sha256(), hashlib.sha256(), 0, b""
    bins, size, height = np.zeros(256, np.int64), 0, 0
    for k, i in enumerate(items):
        media = reader.bytes_of(_uri(folder, i["file"]), i["offset"], i["length"], k == 0)
        _, rows, samples = read_png(media)
        if hashlib.sha256(samples).digest() != bytes(i["digest"]):
            raise ValueError("stored media do not have the digest that names them")
        whole.update(samples)
        form.update(media)
        media_bytes, size, height, tail = media_bytes + len(media), size + len(samples), height + rows, samples[-TAIL:]
        bins += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    positions = ",".join(str(i["pos"]) for i in items)
    return size, whole.hexdigest(), zlib.crc32(tail), media_bytes, form.hexdigest(), feature(WIDTH, height, bins), positions


def assemble(located: DataFrame, key: list[str], folder: str, tasks: int) -> DataFrame:
    """``key`` and READ of each document: its items' media read back in order by ``tasks`` tasks.

    A document's items are gathered, which its own length bounds; documents are
    then dealt out by where their media begin, so that a task reads its files from
    front to back. The stored form of a document is its images one after another.
    """
    item = F.struct("pos", "digest", "file", "offset", "length")
    rows = located.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = F.forall("items", lambda i: i["file"].isNotNull())
    rows = rows.select(*key, F.when(whole, F.col("items")).alias("items"), F.get("items", F.lit(0))["file"].alias("_file"), F.get("items", F.lit(0))["offset"].alias("_offset"))
    rows = rows.repartitionByRange(tasks, "_file", "_offset").sortWithinPartitions("_file", "_offset")

    @F.pandas_udf(READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader, names = _Reader(), [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            found = [(None,) * len(names) if items is None else _read_back(reader, folder, list(items)) for items in batch]
            frame = pd.DataFrame(found, columns=names)
            yield frame.astype(dict.fromkeys(("payload_bytes", "tail_crc32", "media_bytes"), "Int64"))
        reader.close()

    return rows.select(*key, read(F.col("items")).alias("m")).select(*key, "m.*")


# --- the query ----------------------------------------------------------------------


def pieces_of(payload: Column) -> Column:
    """The payload in images' worth, in order."""
    starts = F.sequence(F.lit(0), F.ceil(F.octet_length(payload) / F.lit(PIECE)).cast("int") - 1)
    return F.transform(starts, lambda k: F.substring(payload, k * PIECE + 1, F.lit(PIECE)))


def page_of(lines: Column, digests: Column) -> Column:
    """An HTML page of a document: a paragraph for each line, and its figures set evenly between them."""
    n = F.size(digests)
    # Figure k follows the k-th of n shares of the lines.
    until = lambda k: F.floor(k.cast("long") * F.size(lines) / n).cast("int")
    paragraphs = lambda k: F.concat(F.lit("<p>"), F.array_join(F.slice(lines, until(k) + 1, until(k + 1) - until(k)), "</p><p>"), F.lit("</p>"))
    figure = lambda d, k: F.concat(
        F.lit('<figure><img src="sha256:'), d, F.lit('"><figcaption>grey samples, part '), k + 1, F.lit(" of "), n, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), F.array_join(F.transform(digests, lambda d, k: F.concat(paragraphs(k), figure(d, k))), ""), F.lit("</article>"))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns; the places of each document's figures among its items,
    the number of items and the last caption. Equal texts are shown by one page, which
    is read back once for all of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), text.cast("binary").alias("data")).withColumn("payload", padded(F.col("data")))
    base = base.select("doc_id", "text", "data", pieces_of(F.col("payload")).alias("pieces"))
    folder = fresh_dir(docs.sparkSession, "media")
    places = store(base, folder)
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page, n_bytes = F.unhex(F.sha2("data", 256)).alias("_page"), F.octet_length("data").cast("long").alias("n_bytes")
    parts = base.select("doc_id", page, n_bytes, F.split(safe, "\n").alias("lines"), F.transform("pieces", lambda p: F.sha2(p, 256)).alias("digests"))
    shown = sequences(parts.select("doc_id", "_page", "n_bytes", page_of(F.col("lines"), F.col("digests")).alias("html")), F.col("html"))
    figures = F.filter("items", lambda i: i["kind"] == "media")
    shown = shown.select("doc_id", "_page", "n_bytes", F.size("items").alias("n_items"), figures.alias("figures"))
    refs = F.transform("figures", lambda i: F.struct(i["pos"].alias("pos"), F.unhex(i["digest"]).alias("digest")))
    shown = cut(shown.select("doc_id", "_page", "n_bytes", "n_items", refs.alias("refs"), F.get("figures", F.size("figures") - 1)["caption"].alias("caption")), "media-refs")
    # Copies agree in every reference; they are one page from here on.
    pages = shown.groupBy("_page").agg(F.any_value("refs").alias("refs"))
    stored = places.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).head()["n"]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, stored // SHARE)
    read = assemble(locate(pages.select("_page", F.inline("refs")), places), ["_page"], folder, tasks)
    return shown.select("doc_id", "_page", "n_bytes", "n_items", "caption").join(read, "_page").drop("_page")
