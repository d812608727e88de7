"""Importance resampling towards a target text collection, over hashed n-grams.

Features of a text are all runs of one to three consecutive words; each has a
bucket, the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``. A bucket that is more
frequent in the target than in the documents has a positive gain; a document's
weight is the sum of its features' gains, and with Gumbel noise keyed by its id
the highest scores are a draw without replacement.

Within a task, texts are taken in blocks of about ``BLOCK`` bytes:

* words become numbers (an exact dictionary of the block), documents are set
  apart by two zeros, and suffixes are sorted by their first three numbers;
* neighbours' common prefixes (LCP, up to three) part the suffix array into runs,
  one for each distinct n-gram. A run is hashed once: the CRC of "a b" is that of
  "a" shifted by the length of " b", xor that of " b", so words are the only
  strings that are ever hashed;
* counting adds a run's length to its bucket; scoring scatters the run's bucket
  back to all its places.

A text longer than a block is a block by itself and is sorted in stretches of
``STRETCH`` places that look two words ahead, so no feature is lost or doubled.
Texts are read twice, once to count and once to score; what goes between is a
table of ``BUCKETS`` gains, whatever the size of the data. Ranks come from range
partitions of slim rows.

Defined results: a null or blank text has no features and weight 0; a null id is
hashed as an empty one and sorts first; repeated rows are scored and ranked each;
an empty target has no counts, an empty table gives no rows. Columns that aren't
named pass through with ``keep_rows`` and are not read otherwise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.coding import blocks, byte_table, coded_words
from graphloom.session import cut, numbered

BUCKETS = 10_000
LONGEST = 3
BLOCK, STRETCH = 2 << 20, 1 << 20
SEED = 42
#: Of a hundred documents with at least LEAST_WORDS words, so many are drawn.
SHARE, LEAST_WORDS = 5, 20

#: Bytes of words, after folding A-Z to a-z. Bytes from 128 on only occur in characters beyond ASCII, which are all in words.
INSIDE = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

# --- CRC-32 of runs of words ------------------------------------------------------


def _through(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by its images of the 32 bits, of each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), images[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _doubled(power: int) -> np.ndarray:
    """Images of the bits when 2**power zero bytes follow."""
    if power == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        return bits
    half = _doubled(power - 1)
    return _through(half, half)


@lru_cache(maxsize=4096)
def shift_table(length: int) -> np.ndarray:
    """What a CRC becomes when ``length`` bytes follow it, by each of its four bytes."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for power in range(length.bit_length()):
        if length >> power & 1:
            images = _through(_doubled(power), images)
    each = np.arange(256, dtype=np.uint32)
    return np.concatenate([_through(images, each << np.uint32(8 * i)) for i in range(4)])


class Crc:
    """CRC-32 of runs of a block's words, joined by one space."""

    def __init__(self, words: list[bytes]):
        first = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        later = np.fromiter((zlib.crc32(w, zlib.crc32(b" ")) for w in words), np.uint32, len(words))  # goes on after a space
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        kinds, self.kind = np.unique(lengths, return_inverse=True)
        self.tables = np.concatenate([shift_table(int(n)) for n in kinds])
        self.first, self.later = first, later

    def start(self, word: np.ndarray) -> np.ndarray:
        return self.first[word]

    def follow(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The CRC of the run that goes on with a space and ``word``."""
        at = self.kind[word] * 1024
        out = self.later[word]
        for i in range(4):
            out = out ^ self.tables[at + 256 * i + ((crc >> np.uint32(8 * i)) & np.uint32(255))]
        return out


# --- suffix arrays and their runs -------------------------------------------------


def runs(numbers: np.ndarray, crc: Crc, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of run: (places in suffix order, run of each place, bucket of each run).

    ``numbers`` are word numbers from 1, with zeros for what is in no document; the
    last two places are only looked at, no run begins there. Runs that hold a zero
    have bucket -1.
    """
    columns = [numbers[j : len(numbers) - LONGEST + 1 + j] for j in range(LONGEST)]
    places = np.flatnonzero(columns[0])
    columns = [c[places] for c in columns]
    width = int(numbers.max(initial=0)) + 1
    if width ** LONGEST < 2**63:
        order = np.argsort((columns[0] * width + columns[1]) * width + columns[2])
    else:
        order = np.lexsort(columns[::-1])
    places, columns = places[order], [c[order] for c in columns]
    differs = np.zeros(len(places), bool)  # from the suffix before, within the first k words
    differs[:1] = True
    whole = np.ones(len(places), bool)
    for k, column in enumerate(columns):
        differs[1:] |= column[1:] != column[:-1]
        whole &= column > 0
        heads = np.flatnonzero(differs)
        bucket = np.full(len(heads), -1, np.int64)
        sound = whole[heads]
        at = heads[sound]
        hashed = crc.start(columns[0][at] - 1)
        for later in columns[1 : k + 1]:
            hashed = crc.follow(hashed, later[at] - 1)
        bucket[sound] = hashed % np.uint32(buckets)
        yield places, np.cumsum(differs) - 1, bucket


def _spaced(texts: pa.Array) -> tuple:
    """A block of texts as (numbers with zeros between documents, crc, start of each document, words of each)."""
    numbers, words, counts = coded_words(texts, INSIDE, FOLD)
    starts = np.concatenate([[0], np.cumsum(counts + 2)])
    spaced = np.zeros(starts[-1] + 2, np.int64)
    if len(numbers):
        spaced[np.arange(len(numbers)) + np.repeat(2 * np.arange(len(counts)), counts)] = numbers + 1
    crc = Crc(words) if words else None
    return spaced, crc, starts, counts


def count_block(texts: pa.Array, buckets: int, into: np.ndarray) -> None:
    """Add the features of a block of texts to the counts by bucket."""
    spaced, crc, _, _ = _spaced(texts)
    for begin in range(0, len(spaced) - 2, STRETCH) if crc else ():
        for _, run, bucket in runs(spaced[begin : begin + STRETCH + 2], crc, buckets):
            lengths = np.bincount(run, minlength=len(bucket))
            sound = bucket >= 0
            into += np.bincount(bucket[sound], weights=lengths[sound], minlength=buckets).astype(np.int64)


def weigh_block(texts: pa.Array, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, features, weight) of each text of a block."""
    spaced, crc, starts, counts = _spaced(texts)
    gained = np.zeros(len(spaced) + 1, np.int64)
    padded = np.append(gains, 0)  # bucket -1 gains nothing
    for begin in range(0, len(spaced) - 2, STRETCH) if crc else ():
        for places, run, bucket in runs(spaced[begin : begin + STRETCH + 2], crc, len(gains)):
            gained[1 + begin + places] += padded[bucket][run]
    sums = np.cumsum(gained)
    features = sum(np.maximum(counts - k, 0) for k in range(LONGEST))
    return counts, features, sums[starts[1:]] - sums[starts[:-1]]


# --- Spark ------------------------------------------------------------------------


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features by bucket over all documents; a task sends one row for each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for begin, end in blocks(texts, BLOCK):
                count_block(texts.slice(begin, end - begin), buckets, total)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight: ``buckets`` whole numbers."""
    spark = docs.sparkSession
    have = bucket_counts(docs, text_col, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    want = bucket_counts(target, text_col, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    empty = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = cut(have.unionAll(want).unionAll(empty).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resample-counts")
    whole = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    part = lambda own, all_: (F.col(own) + 1).cast("double") * (F.col(all_) + buckets).cast("double")
    gain = F.floor(1000 * F.log(part("t", "all_s") / part("s", "all_t"))).cast("long")
    rows = each.crossJoin(F.broadcast(whole)).select("bucket", gain.alias("gain")).collect()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row.bucket] = row.gain
    return out


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED, keep_rows: bool = False) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document, with its row if wanted."""
    gained = gains(docs, target, text_col, buckets)
    given = docs.select("doc_id", F.col(text_col).alias("_text"), *([F.struct(*docs.columns).alias("row")] if keep_rows else []))
    kept = [c for c in given.columns if c != "_text"]
    schema = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in kept) + ", n_words long, n_features long, weight long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for begin, end in blocks(texts, BLOCK):
                measured = weigh_block(texts.slice(begin, end - begin), gained)
                passed = [batch.column(c).slice(begin, end - begin) for c in kept]
                yield pa.RecordBatch.from_arrays([*passed, *map(pa.array, measured)], names=[*kept, "n_words", "n_features", "weight"])

    weighed = given.mapInArrow(weigh, schema)
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... over the highest scores, ``share`` of a hundred
    documents that have the least number of words; null for the rest.

    The last key of the order is a number of the row itself, so that rows with one id
    and one score, however many, are spread over ranges too.
    """
    held = cut(scored.withColumn("_row", F.monotonically_increasing_id()), "resample-scores")
    total = held.where(F.col("n_words") >= least_words).count()
    ordered = held.withColumn("_short", F.col("n_words") < least_words).withColumn("_down", -F.col("score"))
    placed = numbered(ordered, "_short", "_down", "doc_id", "_row")
    rank = F.when(F.col("number") < share * total // 100, F.col("number") + 1)
    return placed.select(*scored.columns, rank.cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, text_col: str = "text", share: int = SHARE) -> DataFrame:
    """The documents that are drawn, with the columns of ``docs``."""
    return ranked(scores(docs, target, text_col, keep_rows=True), share).where("rank IS NOT NULL").select("row.*")


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns."""
    return ranked(scores(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def _features(table: str) -> str:
    return rf"""
  SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                     list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT row_number() OVER () AS rid,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table})"""


SQL = rf"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) AS r(i))),
doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         len(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n_words
  FROM documents),
have AS ({_features("documents")}),
want AS ({_features("benchmark")}),
have_n AS (SELECT rid, f, count(*) AS n FROM have GROUP BY rid, f),
want_n AS (SELECT f, count(*) AS n FROM want GROUP BY f),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(f)) + 1), lambda j: ('0x' || substr(hex(encode(f)), 2 * j - 1, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM have_n UNION SELECT f FROM want_n), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM have_n JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM want_n JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket,
         floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE
                         / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket)),
weights AS (
  SELECT rid, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
  FROM have_n JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY rid),
scored AS (
  SELECT doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                     / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (rid)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS r,
         5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS quota
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= quota THEN r END::BIGINT AS rank
FROM placed
"""
