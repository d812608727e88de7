"""Token-count rollups kept up to date by signed deltas.

A store below one folder holds

* ``ledger/<batch>/of=<n>/part=<k>``: signed rows (doc_id, source, lang, version,
  docs, tokens), +1 for a count that is added and -1 for one that is taken back, in
  n buckets by a hash of doc_id. n is a power of two with about ``ROWS`` rows to a bucket,
  so a load is written by as many tasks as it needs and a small batch by few;
* ``totals/<batch>``: the rollup by source, language and tokenizer version as it
  stands after the batch;
* ``commits/<n>-<batch>``: an empty file, made last, that makes the batch count.

A batch of changes is turned into signed rows: an insert adds its count; a
delete takes back what the ledger holds of the document; a revision does both.
Only the buckets of the ids that the batch takes back are read, and of those
the rows of these ids, before anything is grouped. New totals are the old ones
plus the batch's sums, so no text is counted again. ``fold`` is a batch without
changes that writes what the ledger adds up to, once for each document that is
left, in buckets of its own number; earlier batches are not read after it. Every ``FOLD``
batches one is made, and what came before the fold before it is deleted: a reader that began
before the last fold still finds its files.
A batch that is already committed is left alone; one that was cut short left no
commit file and is written over when it is run again. Batches have one writer.

Batches named ``fold-...`` are the store's own and refused from callers. Defined results: repeated inserts of a row count each time; a delete or a
revision takes back all counts of its document and version, and a delete with
a null version those of every version; one of an unknown document takes back
nothing; null sources and languages are groups of their own; a null doc_id can
be inserted but not taken back; groups whose documents come to zero vanish.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import n_words
from graphloom.session import cut, fresh_dir

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts text before the merges of RANKS.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_BREAK = "\u00a0"
GROUP = ("source", "lang", "version")
LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long"
#: Rows to a bucket of a ledger, least and most buckets, and batches between two folds.
ROWS, PARTS, MOST_PARTS, FOLD = 1_000_000, 32, 1 << 16, 16
TOTALS = "source string, lang string, version string, docs long, tokens long"


class Rollup:
    """A store of rollups below ``path``."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, fold_after: int = FOLD):
        self.spark, self.path, self.parts, self.fold_after = spark, path, parts, fold_after

    def _fs(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def committed(self) -> list[str]:
        """The committed batches in their order."""
        store, at = self._fs("commits")
        names = sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []
        return [n.partition("-")[2] for n in names]

    def _read(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{b}" for b in batches))

    def _live(self) -> list[str]:
        """The committed batches from the last fold on."""
        done = self.committed()
        last = max((i for i, b in enumerate(done) if b.startswith("fold-")), default=0)
        return done[last:]

    def ledger(self) -> DataFrame:
        """All signed rows that are still read, with their bucket ``part`` and the number ``of`` buckets."""
        schema = f"{LEDGER}, of int, part int"
        found = [self.spark.read.schema(schema).parquet(f"{self.path}/ledger/{b}") for b in self._live()]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def _widths(self) -> list[int]:
        """The numbers of buckets that live batches have."""
        out = set()
        for batch in self._live():
            store, at = self._fs(f"ledger/{batch}")
            out |= {int(f.getPath().getName()[3:]) for f in store.listStatus(at) if f.getPath().getName().startswith("of=")}
        return sorted(out)

    def width(self, rows: int) -> int:
        """Buckets for so many rows: a power of two times ``parts``, which is one itself."""
        n = self.parts
        while n * ROWS < rows and n < MOST_PARTS:
            n *= 2
        return n

    def totals(self) -> DataFrame:
        """The rollup after the last committed batch."""
        return self._read("totals", self.committed()[-1:], TOTALS)

    def _signed(self, changes: DataFrame) -> DataFrame:
        added = changes.where(F.col("op").isin("insert", "revise")).select(
            "doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").cast("long").alias("tokens")
        )
        gone = changes.where(F.col("op").isin("delete", "revise") & F.col("doc_id").isNotNull())
        gone = gone.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).distinct()
        # At most MOST_PARTS numbers come to the driver for each width.
        touched = F.lit(False)
        for n in self._widths():
            parts = [r["part"] for r in gone.select(self._part(F.col("_doc"), n).alias("part")).distinct().collect()]
            touched = touched | ((F.col("of") == n) & (F.col("part").isin(parts) if len(parts) < n else F.lit(True)))
        match = (F.col("doc_id") == F.col("_doc")) & (F.col("_version").isNull() | (F.col("version") == F.col("_version")))
        held = self.ledger().where(touched).join(gone, match, "left_semi")
        back = held.groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")
        return added.unionByName(back.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))

    def _part(self, doc_id: Column, n: int) -> Column:
        return F.when(doc_id.isNotNull(), F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int"))

    def _write(self, rows: DataFrame, batch: str, n: int) -> None:
        """The batch's part of the ledger: a file or two for each of ``n`` buckets."""
        # Rows without an id can't be taken back; any bucket may have them.
        spread = F.coalesce(self._part(F.col("doc_id"), n), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
        rows = rows.withColumn("of", F.lit(n)).withColumn("part", spread).repartition(n, "part")
        rows.write.mode("overwrite").partitionBy("of", "part").parquet(f"{self.path}/ledger/{batch}")

    def _commit(self, batch: str, before: list[str], totals: DataFrame) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        store, at = self._fs(f"commits/{len(before):09d}-{batch}")
        store.create(at, True).close()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply (op, doc_id, source, lang, version, n_tokens) once; False if done before."""
        if batch.startswith("fold-"):
            raise ValueError("names that begin with fold- are the store's own")
        before = self.committed()
        if batch in before:
            return False
        # A revision may take back one row for each that it adds; counts of tokens are not made for this.
        self._write(self._signed(changes), batch, self.width(2 * changes.count()))
        delta = self._read("ledger", [batch], LEDGER).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        both = self._read("totals", before[-1:], TOTALS).unionByName(delta)
        after = both.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")
        self._commit(batch, before, after)
        if len(self._live()) > self.fold_after:
            self.fold()
        return True

    def fold(self) -> None:
        """Write what the ledger adds up to as a batch of its own, after which no earlier one is read."""
        before = self.committed()
        whole = self.ledger().groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        batch = f"fold-{len(before)}"
        whole = cut(whole.where("docs <> 0 OR tokens <> 0"), "rollup-fold")
        self._write(whole, batch, self.width(whole.count()))
        self._commit(batch, before, self._read("totals", before[-1:], TOTALS))
        folds = [i for i, b in enumerate(before) if b.startswith("fold-")]
        for old in before[: folds[-1]] if folds else ():
            for kind in ("ledger", "totals"):
                store, at = self._fs(f"{kind}/{old}")
                store.delete(at, True)


def bpe_counts(text: Column, ranks: str = RANKS) -> Column:
    """Number of byte-pair tokens of a text; 0 for null."""
    with open(ranks, "rb") as f:
        data = f.read()
    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(data)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        pairs = (line.split() for line in sent.value.splitlines() if line)
        made = {base64.b64decode(a): int(b) for a, b in pairs}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=made, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def changes(docs: DataFrame, op: str, version: str, n_tokens: Column) -> DataFrame:
    """A batch that does ``op`` to every row of ``docs``."""
    return docs.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), n_tokens.cast("long").alias("n_tokens"))


def query(docs: DataFrame) -> DataFrame:
    """The totals after a life of batches over all documents.

    Every document is inserted with provisional counts (a token for four bytes,
    and its words); the byte-pair version is revised to exact counts, which for rows without an
    id, as they can't be revised, are the first ones; the words
    of the few texts with a no-break space are revised, which then parts words;
    copies of a text with a smaller id are deleted; then two batches are sent
    again, as after a lost acknowledgement, and change nothing.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, fresh_dir(spark, "rollup"))
    text = F.col("text")
    guess = F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(4))
    known = docs.where("doc_id IS NOT NULL")
    first = changes(known, "insert", "byte_bpe_50k", guess).unionByName(changes(docs, "insert", "words", n_words(text)))
    rollup.commit("load", first)
    exact = changes(docs, "revise", "byte_bpe_50k", bpe_counts(text))  # of rows without an id, an insert
    rollup.commit("recount", exact)
    wide = known.where(F.contains(text, F.lit(NO_BREAK)))
    rollup.commit("no-break", changes(wide, "revise", "words", n_words(F.replace(text, F.lit(NO_BREAK), F.lit(" ")))))
    hashed = docs.select("doc_id", F.sha2(F.coalesce(text, F.lit("")), 256).alias("_hash"))
    kept = hashed.groupBy("_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    copies = docs.select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    gone = copies.select(F.lit("delete").alias("op"), "doc_id", *(F.lit(None).cast("string").alias(c) for c in GROUP), F.lit(0).cast("long").alias("n_tokens"))
    rollup.commit("dedup", gone)
    rollup.commit("recount", exact)
    rollup.commit("dedup", gone)
    return rollup.totals().withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})
