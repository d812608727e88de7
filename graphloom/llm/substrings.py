"""Substring dedup: documents as factors of what earlier documents hold.

A word goes if a window of ``WINDOW`` words that covers it also begins in a
document with a smaller id. The documents are parsed relative to one another, as
in relative Lempel-Ziv parsing:

1. Reference blocks. Texts are written to the shared folder in blocks of about
   ``BLOCK`` bytes. A block's index is its anchors: in every window the run of
   ``ANCHOR`` words with the least hash, so that equal windows have equal anchors.
   An anchor is one row of a block however often it is there, so a passage that
   a third of all documents share is as many rows as there are blocks.
2. Factors. One shuffle by anchor finds, for those in more than one document, the
   first document that has them, with block and place, and tells it to the blocks
   that hold them. A block extends its documents' factors greedily: from anchor to
   anchor, as long as the next one lies at the same distance in the same reference
   block. Neighbouring anchors are at most ``ANCHOR`` words apart, so equal anchors on one
   diagonal are equal text. Factors of ``WINDOW`` words or more, of a reference with a
   smaller id, are duplicate spans.
3. Factor boundaries. Windows that hold a shared anchor and lie in no factor - across a
   boundary, or first occurrences - are compared by 128-bit keys in the same way:
   one row a block, one shuffle, the first document told to the blocks.
   Their texts can't be in a document that has none of their anchors.
4. Spans and boundary windows are laid over the words, and the rest is kept.

Only blocks are read again, from the shared folder, by the task that needs them; texts
are never shuffled, and what is shuffled is a row for some four words and then one
for each window left. Memory is bounded by a block, or by one longer document.

Defined results: a null text has no words; a row without an id keeps all its
words and is no one's reference; rows with one id are one document and no
duplicates of each other; texts of fewer than ``WINDOW`` words stay whole; kept words are
joined by one space; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.coding import blocks, byte_table, coded_words
from graphloom.session import cut, fresh_dir

WINDOW, ANCHOR = 13, 7
#: Runs of ANCHOR words that begin within a window.
CHOICES = WINDOW - ANCHOR + 1
BLOCK, STRETCH = 4 << 20, 1 << 20
#: Rows of a shuffle that one of its partitions gets, about.
ROWS = 1_000_000
#: Bytes of words: all but white space.
INSIDE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)

# --- a block in memory ------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), _MIX):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


def _least(x: np.ndarray, pick) -> np.ndarray:
    """The least or greatest of each CHOICES neighbours, in a few steps of doubled width."""
    width, out = 1, x
    while width < CHOICES:
        step = min(width, CHOICES - width)
        out = pick(out[: len(out) - step], out[step:])
        width += step
    return out


class Block:
    """Documents of a block as one line of words, with WINDOW empty places after each.

    ``hashes`` has two rows of 64-bit word hashes, ``left`` the words from a place to
    its document's end (0 on empty places and in documents without an id).
    """

    def __init__(self, ids: pa.Array, texts: pa.Array):
        numbers, words, self.counts = coded_words(texts, INSIDE)
        self.starts = np.concatenate([[0], np.cumsum(self.counts + WINDOW)])
        places = np.arange(len(numbers)) + np.repeat(WINDOW * np.arange(len(self.counts)), self.counts)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        self.hashes = np.zeros((2, self.starts[-1]), np.uint64)
        self.hashes[:, places] = digests[numbers].T
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.left = np.zeros(self.starts[-1], np.int64)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left[places] = np.where(known[owner], self.starts[owner] + self.counts[owner] - places, 0)
        self.places, self.anchors = self._anchors()

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the anchors of all windows, in order of places."""
        found, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for begin in range(0, len(self.left), STRETCH):
            line = self.hashes[0, begin : begin + STRETCH + WINDOW - 1]
            if len(line) < WINDOW:
                break
            run = np.zeros(len(line) - ANCHOR + 1, np.uint64)
            for j in range(ANCHOR):
                run = run * _FACTORS[0] + line[j : j + len(run)]
            run = np.maximum(_mixed(run), np.uint64(1))
            least = _least(run, np.minimum)
            least[self.left[begin : begin + len(least)] < WINDOW] = 0
            around = np.zeros(CHOICES - 1, np.uint64)
            at = np.flatnonzero(_least(np.concatenate([around, least, around]), np.maximum) == run)
            found.append(at + begin)
            keys.append(run[at])
        places, first = np.unique(np.concatenate(found), return_index=True)
        return places, np.concatenate(keys)[first]

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The row of each place."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def keys(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit keys of the windows that begin at ``places``."""
        out = []
        for line, factor in zip(self.hashes, _FACTORS):
            key = np.zeros(len(places), np.uint64)
            for j in range(WINDOW):
                key = key * factor + line[places + j]
            out.append(_mixed(key))
        return out[0], out[1]

    def told(self, answers: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, places of windows to compare): factors, and windows with a shared anchor in none."""
        order = np.argsort(answers["key"])
        keys = answers["key"][order]
        at = np.minimum(np.searchsorted(keys, self.anchors), max(len(keys) - 1, 0))
        shared = keys[at] == self.anchors if len(keys) else np.zeros(len(self.anchors), bool)
        places, at = self.places[shared], order[at[shared]]
        own = self.documents(places)
        doc, block, place = (answers[c][at] for c in ("first_doc", "first_block", "first_place"))
        earlier = doc < self.ids[own]
        step = places[1:] - places[:-1]
        goes_on = earlier[1:] & earlier[:-1] & (own[1:] == own[:-1]) & (doc[1:] == doc[:-1]) & (block[1:] == block[:-1])
        goes_on &= (place[1:] - place[:-1] == step) & (step <= ANCHOR)
        heads = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(places) else np.zeros(0, np.int64)
        tails = np.append(heads[1:], len(places)) - 1 if len(heads) else heads
        begin, end = places[heads], places[tails] + ANCHOR
        long = earlier[heads] & (end - begin >= WINDOW)
        begin, end = begin[long], end[long]
        # Windows with a shared anchor in them ...
        count = np.zeros(len(self.left) + 1, np.int32)
        np.add.at(count, np.maximum(places - CHOICES + 1, 0), 1)
        np.add.at(count, places + 1, -1)
        # ... and in no factor: those that begin from a factor's begin to WINDOW words before its end lie in it.
        inside = np.zeros(len(self.left) + 1, np.int32)
        inside[begin] += 1
        inside[end - WINDOW + 1] -= 1
        open_ = (np.cumsum(count[:-1]) > 0) & (np.cumsum(inside[:-1]) == 0) & (self.left >= WINDOW)
        return begin, end, np.flatnonzero(open_)

    def covered(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """True for the places that spans cover."""
        steps = np.zeros(len(self.left) + 1, np.int32)
        np.add.at(steps, begin, 1)
        np.add.at(steps, end, -1)
        return np.cumsum(steps[:-1]) > 0


# --- blocks in the shared folder --------------------------------------------------

BLOCKS = "block long, uri string, size long"


def write_blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts in files of the shared folder; a row for each file that counts."""
    folder = fresh_dir(docs.sparkSession, "reference-blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, size
            name = f"{uuid.uuid4().hex}.arrow"
            table = pa.Table.from_batches(held)
            with store.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
                sink.write_table(table)
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f"{folder}/{name}"]), pa.array([size])], names=["block", "uri", "size"])
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            texts = batch.column(1)
            for begin, end in blocks(texts, BLOCK):
                part = batch.slice(begin, end - begin)
                bytes_ = part.column(1).nbytes
                if held and size + bytes_ > BLOCK:
                    yield close()
                held.append(part)
                size += bytes_
        if held:
            yield close()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(given.mapInArrow(write, BLOCKS), "substring-blocks")


def read_block(uri: str) -> pa.Table:
    """The documents of a block, over any store that Arrow can reach."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as file:
        return pa.ipc.open_stream(file).read_all().combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _open(uri: str) -> tuple[Block, pa.Array, pa.Array]:
    table = read_block(uri)
    ids, texts = _column(table, "doc_id"), _column(table, "text")
    return Block(ids, texts), ids, texts


# --- rounds -----------------------------------------------------------------------

#: What differs from row to row stands together, and so does what doesn't, so that shuffled rows pack well.
ENTRY = "key2 long, key long, place long, low long, high long, block long"


def _entries(block: int, keys: np.ndarray, keys2: np.ndarray, docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """One row a key: the least document that has it in the block, with its place, and the greatest."""
    order = np.lexsort((places, docs, keys2, keys))
    keys, keys2, docs, places = (c[order] for c in (keys, keys2, docs, places))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (keys2[1:] != keys2[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(keys)) - 1 if len(heads) else heads
    # In order of places, neighbours have like places and documents, and shuffled rows pack better by a third.
    by_place = np.argsort(places[heads])
    heads, tails = heads[by_place], tails[by_place]
    columns = [keys2[heads].view(np.int64), keys[heads].view(np.int64), places[heads], docs[heads], docs[tails], np.full(len(heads), block)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in ENTRY.split(", ")])


def first_seen(entries: DataFrame, n: int) -> DataFrame:
    """The entries whose key is in more than one document, each with the key's first document.

    A key has one row a block, so the window of a key that all documents have holds
    as many rows as there are blocks.
    """
    dealt = entries.repartition(n, "key", "key2")
    whole = Window.partitionBy("key", "key2").orderBy("low", "block", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = [F.first(c).over(whole).alias(a) for c, a in (("low", "first_doc"), ("block", "first_block"), ("place", "first_place"))]
    out = dealt.select("block", "key2", "key", *firsts, F.max("high").over(whole).alias("_last"))
    return out.where("first_doc < _last").drop("_last")


def _answers(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: _column(table, c).to_numpy(zero_copy_only=False) for c in table.column_names if c not in ("uri", "size")}
    return out | {c: out[c].astype(np.int64).view(np.uint64) for c in ("key", "key2")}


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document and the text that is left of it."""
    held = write_blocks(docs, text_col)
    total = held.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    n_blocks = max(1, min(total.blocks, 100_000))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, uri in zip(batch.column("block").to_pylist(), batch.column("uri").to_pylist()):
                block = _open(uri)[0]
                owner = block.ids[block.documents(block.places)]
                yield _entries(number, block.anchors, np.zeros_like(block.anchors), owner, block.places)

    def windows(key, answers: pa.Table, files: pa.Table) -> pa.Table:
        block = _open(files.column("uri")[0].as_py())[0]
        _, _, places = block.told(_answers(answers))
        out = _entries(key[0].as_py(), *block.keys(places), block.ids[block.documents(places)], places)
        return pa.Table.from_batches([out])

    def keep(key, answers: pa.Table, files: pa.Table) -> pa.Table:
        block, ids, texts = _open(files.column("uri")[0].as_py())
        said = _answers(answers)
        window = said.pop("window").astype(bool)
        begin, end, places = block.told({c: v[~window] for c, v in said.items()})
        known = np.stack([said["key"][window], said["key2"][window]])
        first = said["first_doc"][window]
        order = np.lexsort(known[::-1])
        known, first = known[:, order], first[order]
        one, two = block.keys(places)
        earlier = np.zeros(len(places), bool)
        if len(first):
            at = _find(known, one, two)
            hit = at >= 0
            earlier[hit] = first[at[hit]] < block.ids[block.documents(places[hit])]
        again = places[earlier]
        gone = block.covered(np.concatenate([begin, again]), np.concatenate([end, again + WINDOW]))
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[block.starts[1:]] - removed[block.starts[:-1]]
        kept = []
        for i, text in enumerate(texts):
            words = (text.as_py() or "").encode().split()
            if n_removed[i]:
                words = compress(words, ~gone[block.starts[i] : block.starts[i] + block.counts[i]])
            kept.append(b" ".join(words).decode())
        return pa.table({"doc_id": ids, "n_words": block.counts, "n_removed": n_removed, "kept": pa.array(kept, pa.string())})

    dealt = held.select("block", "uri").repartition(n_blocks, "block")
    rows = max(1, total.size // 20)
    n = max(held.sparkSession.sparkContext.defaultParallelism, rows // ROWS)
    shared = cut(first_seen(dealt.mapInArrow(anchors, ENTRY), n), "substring-anchors")
    grouped = held.select("block", "uri").groupBy("block")
    compared = shared.groupBy("block").cogroup(grouped).applyInArrow(windows, ENTRY)
    windows_seen = first_seen(compared, n)
    told = shared.withColumn("window", F.lit(0)).unionByName(windows_seen.withColumn("window", F.lit(1)))
    return told.groupBy("block").cogroup(grouped).applyInArrow(keep, RESULT)


def _find(known: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The column of ``known``, sorted pairs without repeats, that equals each pair; -1 if none."""
    at = np.searchsorted(known[0], one)
    out = np.full(len(one), -1, np.int64)
    for _ in range(int(np.unique(known[0], return_counts=True)[1].max(initial=0))):
        inside = np.minimum(at, known.shape[1] - 1)
        hit = (at < known.shape[1]) & (known[0][inside] == one) & (known[1][inside] == two)
        out[hit] = inside[hit]
        at = at + 1
    return out


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, doc_id, p, array_to_string(w[p:p + 12], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM t WHERE len(w) >= 13)),
first AS (SELECT words, min(doc_id) AS first FROM win GROUP BY words),
gone AS (
  SELECT DISTINCT rid, unnest(range(p, p + 13)) AS p FROM win JOIN first USING (words) WHERE doc_id > first.first),
spread AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS k FROM spread ANTI JOIN gone USING (rid, p) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN counts USING (rid) LEFT JOIN kept USING (rid)
"""
