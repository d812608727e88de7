"""Mixing sources to target weights along a time-varying curriculum.

1. Targets. Sources, in code point order with null last, get weights 1, 2, 3
   in turn and share all words; no source is asked for more than three times
   what it holds, and what the cap frees is shared anew by weight. That fixed
   point is ``min(cap, level * weight)``; the level is found in closed form
   with windows over the table of sources. Sources are the rows of a table of
   weights: one task sorts them (with spilling), some ten million at most.
2. Order. Each source's documents are put in a keyed random order (the MD5 of
   the id and the text's MD5, so that rows of one id, or of none, are spread too). A source's
   running word count comes from two windows, one within buckets of the order and
   one over the bucket totals. There are 4,096 buckets a source, and 16 times as many for each
   16 times as many rows, so that a bucket of a source that holds all rows has about ``ROWS``.
   Only rows that repeat one id and text can fill a bucket: those of a key with more than ``HOT`` rows are one
   row of their bucket's window and are numbered among themselves in ``SALTS`` parts.
3. Amount. A source whose target is k and a fraction times its size is passed
   over k times and then up to the exact word where the target is met.
4. Curriculum. A source's weight at time t in [0, 1] is ``a + (b - a) t``. Its
   integral gives the source's cumulative demand, which is inverted to find
   the time, and from it the position in the training stream, at which a
   document is first due. Rows leave range-sorted by that position. ``mixed``
   places each pass over a source at its own part of the demand.

Defined results: null or blank texts have size 0 and take 0 words; a null
source is a source of its own; null ids sort first; repeated rows are separate
documents; an empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.text import n_words
from graphloom.session import cut

#: At most this many passes over a source.
CAP = 3
#: By weight: the weight schedule's value at the start and at the end.
#: Each pair sums to 2, so that every schedule's integral over [0, 1] is 1.
SCHEDULES = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}
#: Least hexadecimal digits of the order key that name a bucket, rows that more digits aim at, and rows of a key that are dealt out.
BUCKET_DIGITS, ROWS, HOT, SALTS = 3, 250_000, 1_000_000, 256


def _schedule(weight: Column, end: int) -> Column:
    out = F.lit(None).cast("double")
    for w, pair in SCHEDULES.items():
        out = F.when(weight == w, F.lit(pair[end])).otherwise(out)
    return out


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): weight, target, whole words and schedule.

    Taking sources in order of size over weight, with the first k of them at
    their cap the level would be what is left over the weight that is left.
    The sum of ``min(cap, level * weight)`` is the least of these linear
    pieces, so the level that gives the total is the largest of theirs.
    The table has a row for each source, so its windows need no partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    capped = CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - capped).cast("double") / (F.sum("weight").over(whole) - weighed).cast("double")
    step = (
        sizes.withColumn("weight", (((F.row_number().over(by_name) - 1) % 3) + 1).cast("long"))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(whole))
    )
    target = F.least((CAP * F.col("source_size")).cast("double"), F.col("_level") * F.col("weight").cast("double"))
    step = step.withColumn("target", target).withColumn("whole", F.floor("target").cast("long"))
    step = step.withColumn("a", _schedule(F.col("weight"), 0)).withColumn("b", _schedule(F.col("weight"), 1))
    return step.select(
        "source", "source_size", "weight", "target", "whole", "a", "b",
        F.sum(F.col("whole") * F.col("a")).over(whole).alias("linear"),
        F.sum(F.col("whole") * (F.col("b") - F.col("a"))).over(whole).alias("square"),
    )


def due(share: Column, a: Column, b: Column) -> Column:
    """The time at which a schedule ``a + (b - a) t`` has met ``share`` of its demand.

    The root of ``(b - a) / 2 t^2 + a t = share (a + b) / 2`` in the form that
    also holds for a flat schedule.
    """
    return share * (a + b) / (a + F.sqrt(a * a + (b - a) * (a + b) * share))


def _position(at: Column) -> Column:
    """The training position at which word ``at`` of a source's demand is due."""
    share = at / F.nullif(F.col("whole").cast("double"), F.lit(0.0))
    t = due(share, F.col("a"), F.col("b"))
    return F.floor(F.col("linear") * t + F.col("square") / 2 * t * t).cast("long")


def bucket_digits(rows: int) -> int:
    """Digits of the key that part so many rows into buckets of about ``ROWS``, if one source has them all."""
    digits = BUCKET_DIGITS
    while 16**digits * ROWS < rows and digits < 8:
        digits += 1
    return digits


def _running(sized: DataFrame, words: str = "size") -> DataFrame:
    """``sized`` with ``_ahead``, the words before a row in its bucket."""
    tie = [F.xxhash64("row")] if "row" in sized.columns else []
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", *tie).rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("_ahead", F.coalesce(F.sum(words).over(within), F.lit(0)))


def _running_around(sized: DataFrame, full: DataFrame) -> DataFrame:
    """The same where some buckets (``full``, at most a row for each ``HOT`` rows) may hold a key of very many rows.

    Such a key's rows have one size: together they are one row of their bucket's window, and the words before each
    are those before its part, and its number within it, times that size.
    """
    of = ["_source", "_key"]
    counted = sized.join(F.broadcast(full), ["_source", "_bucket"], "left_semi").groupBy("_source", "_bucket", "_key").agg(F.max("size").alias("size"), F.count("*").alias("_n"))
    hot = cut(counted.where(F.col("_n") > HOT), "mix-hot")
    names = F.broadcast(hot.select(*of))
    group = hot.select(*of, "_bucket", "size", (F.col("size") * F.col("_n")).alias("_words"), F.lit(True).alias("_group"))
    plain = sized.join(names, of, "left_anti").withColumn("_words", F.col("size")).withColumn("_group", F.lit(False))
    run = _running(plain.unionByName(group, allowMissingColumns=True), "_words")
    begun = run.where("_group").select(*of, F.col("_ahead").alias("_begin"))
    dealt = cut(sized.join(names, of, "left_semi").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "mix-dealt")
    parts = dealt.groupBy(*of, "_salt").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*of).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # over at most SALTS rows
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    number = F.row_number().over(Window.partitionBy(*of, "_salt").orderBy("size")) - 1
    rows = dealt.withColumn("_number", number).join(F.broadcast(parts), [*of, "_salt"]).join(F.broadcast(begun), of)
    rows = rows.withColumn("_ahead", F.col("_begin") + (F.col("_before") + F.col("_number")) * F.col("size"))
    return run.where("NOT _group").select(*sized.columns, "_ahead").unionByName(rows.select(*sized.columns, "_ahead"))


def mix(docs: DataFrame, text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """A row for each document: what the mix takes of it and when it is first due.

    Columns: doc_id, source, size, source_size, target, taken, copies (whole
    copies in the mix: a document cut by its source's end counts if at least
    half of it is taken), position (null if nothing is taken), positions (one
    for each copy, null if there is none), and with ``keep_rows`` the input row
    as a struct ``row``.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest))
    sized = docs.select(
        "doc_id", "source", n_words(F.col(text_col)).alias("size"), key.alias("_key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), F.substring(key, 1, bucket_digits(docs.count())).alias("_bucket"),
        *([F.struct(*docs.columns).alias("row")] if keep_rows else []),
    )
    sized = sized if keep_rows else cut(sized, "mix-sizes")
    buckets = sized.groupBy("source", "_source", "_bucket").agg(F.sum("size").alias("_bucket_size"), F.count("*").alias("_rows"))
    buckets = cut(buckets, "mix-buckets")
    sources = source_targets(buckets.groupBy("source").agg(F.sum("_bucket_size").alias("source_size")))
    sources = sources.withColumn("_of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_bucket_size").over(ahead), F.lit(0)))
    starts = starts.join(sources, F.col("_source") == F.col("_of")).drop("source", "_of", "_bucket_size", "_rows")
    full = buckets.where(F.col("_rows") > HOT).select("_source", "_bucket")
    placed = _running(sized) if full.isEmpty() else _running_around(sized, full)
    joined = placed.join(starts, ["_source", "_bucket"])
    joined = joined.withColumn("_at", F.col("_start") + F.col("_ahead"))
    full = F.coalesce(F.floor(F.col("whole") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    joined = joined.withColumn("_full", full)
    over = F.col("whole") - F.col("_full") * F.col("source_size") - F.col("_at")
    joined = joined.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), over)))
    joined = joined.withColumn("taken", (F.col("_full") * F.col("size") + F.col("_part")).cast("long"))
    half = ((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("size"))).cast("long")
    joined = joined.withColumn("copies", F.col("_full") * (F.col("size") > 0).cast("long") + half)
    # Pass p over a source starts after p times its words.
    passes = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: _position(p * F.col("source_size") + F.col("_at")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copies",
        F.when(F.col("taken") > 0, _position(F.col("_at"))).alias("position"), F.when(F.col("copies") > 0, passes).alias("positions"),
        *(["row"] if keep_rows else []),
    )


def mixed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: whole documents with the columns of ``docs``, a copy for
    each time they are taken, range-sorted by each copy's training position."""
    plan = mix(docs, text_col, keep_rows=True)
    copies = plan.select(F.explode("positions").alias("position"), "doc_id", "row")
    return copies.orderBy("position", "doc_id", F.xxhash64("row")).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, range-sorted by training position; ``positions`` are comma-joined."""
    plan = mix(docs).withColumn("positions", F.array_join("positions", ","))
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM src),
lev AS (
  SELECT *,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS piece
  FROM ranked
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(piece) OVER () * weight::DOUBLE) AS target,
         CASE weight WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS a,
         CASE weight WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END::DOUBLE AS b
  FROM lev),
plan AS (
  SELECT *, floor(target)::BIGINT AS whole, sum(floor(target) * a) OVER () AS linear,
         sum(floor(target) * (b - a)) OVER () AS square
  FROM tgt),
placed AS (
  SELECT row_number() OVER () AS rid, doc_id, s.source, size, source_size, target, whole, a, b, linear, square,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS beg
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
-- Every pass over a source, laid end to end: what of the document lies before the target is taken.
passes AS (
  SELECT *, p * source_size + beg AS spot, greatest(0, least(size, whole - (p * source_size + beg))) AS got
  FROM placed CROSS JOIN (SELECT unnest(range(0, 4)) AS p)),
timed AS (
  SELECT *, spot / whole::DOUBLE * (a + b) / (a + sqrt(a * a + (b - a) * (a + b) * (spot / whole::DOUBLE))) AS t
  FROM passes WHERE got > 0),
due AS (SELECT *, floor(linear * t + square / 2 * t * t)::BIGINT AS pos FROM timed),
each AS (
  SELECT rid, sum(got) AS taken, count(*) FILTER (2 * got >= size) AS copies, min(pos) FILTER (p = 0) AS position,
         string_agg(pos::VARCHAR, ',' ORDER BY p) FILTER (2 * got >= size) AS positions
  FROM due GROUP BY rid)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(copies, 0)::BIGINT AS copies,
       position, positions
FROM placed LEFT JOIN each USING (rid)
"""
