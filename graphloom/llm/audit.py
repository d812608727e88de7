"""Filter interaction audit: what each filter removes in every order of filters.

1. Flags. One projection measures a text and sets a bit for each filter that it
   fails. The filter on copies compares texts table-wide by SHA-256: the least id
   of each digest is found with map-side combining and joined back to slim rows,
   which are written first, so that a digest or an id with a third of all rows is
   split by AQE.
2. Replay. Every document's flags meet all orders of the filters, a broadcast
   table of 120 rows; five steps are exploded from each, the first failure is
   the first step whose bit is set, and conditional sums are combined in the task
   before anything is shuffled: a task sends 600 rows for each part it has seen.

Each document is replayed by itself: 600 short-lived rows in generated code,
never stored or shuffled.

Defined results: a null text is the empty text; a null part is the empty string,
and merges with it; a row without an id is no copy of any and none of its;
repeated rows count each; a label row without an id or with null marks says
nothing, and one of several rows for an id that marks it is enough; an empty
table gives no rows. Columns that aren't named are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.text import words
from graphloom.session import cut

#: The filters by letter: the bit that marks a failure.
BITS = {letter: 1 << i for i, letter in enumerate("ABCDE")}
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, tokens: Column) -> Column:
    """The bits of the filters that look at one text: A to D."""
    n = F.size(tokens)
    fails = {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(tokens)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    out = F.lit(0)
    for letter, failed in fails.items():
        out = out + F.when(failed, BITS[letter]).otherwise(0)
    return out


def flags(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, fails, good, toxic): a row for each document, ``fails`` as bits."""
    step = docs.select("doc_id", F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    step = step.withColumn("_words", words(F.col("_text")))
    slim = step.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("_digest"), text_failures(F.col("_text"), F.col("_words")).alias("_bits"))
    slim = cut(slim, "audit-flags")
    firsts = slim.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    firsts = cut(firsts.where("_first < _last").drop("_last"), "audit-firsts")
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = cut(marks.where("doc_id IS NOT NULL AND (good OR toxic)"), "audit-marks")
    later = F.when(F.col("doc_id") > F.col("_first"), BITS["E"]).otherwise(0)
    out = slim.join(firsts, "_digest", "left").select("doc_id", "part", (F.col("_bits") + later).alias("fails"))
    out = out.join(marks, "doc_id", "left")
    return out.select("doc_id", "part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def replay(flagged: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The audit of ``flagged`` rows (part, fails, good, toxic) over all orders of ``letters``."""
    spark = flagged.sparkSession
    orders = ["".join(o) for o in permutations(letters)]
    table = spark.createDataFrame([(i, *(BITS[c] for c in o)) for i, o in enumerate(orders)], "_order int, " + ", ".join(f"_b{i} int" for i in range(len(letters))))
    bits = [F.col(f"_b{i}") for i in range(len(letters))]
    first = F.lit(len(letters) + 1)
    for i in reversed(range(len(letters))):
        first = F.when(F.col("fails").bitwiseAND(bits[i]) != 0, i + 1).otherwise(first)
    crossed = flagged.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(table))
    crossed = crossed.select("part", "fails", "good", "toxic", "_order", first.alias("_first"), F.posexplode(F.array(*bits)).alias("_at", "_bit"))
    step = F.col("_at") + 1
    removed = F.col("_first") == step
    count = lambda test, name: F.sum(F.when(test, 1).otherwise(0).cast("long")).alias(name)
    counted = crossed.groupBy("part", "_order", "_at", "_bit").agg(
        count(F.col("_first") > step, "kept"), count(removed, "removed"),
        count((F.col("fails").bitwiseAND(F.col("_bit")) != 0) & (F.col("_first") < step), "redundant"),
        count(F.col("fails") == F.col("_bit"), "unique_fails"), count(removed & F.col("good"), "good_lost"), count(removed & F.col("toxic"), "toxic_lost"),
    )
    counted = counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_bit")))
    name = F.element_at(F.array(*map(F.lit, orders)), F.col("_order") + 1)
    return counted.select("part", name.alias("filter_order"), (F.col("_at") + 1).alias("step"), *COUNTS)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: 600 for each part."""
    return replay(flags(docs, labels))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
copies AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(w) < 100 THEN 'A' END,
                CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                CASE WHEN doc_id > copies.first THEN 'E' END) AS fails
  FROM t JOIN copies USING (text) LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS l, substr(filter_order, 1, s - 1) AS earlier
          FROM orders, (SELECT unnest(range(1, 6)) AS s)),
each AS (
  SELECT part, filter_order, step, l, good, toxic, fails, contains(fails, l) AS failing,
         translate(earlier, fails, '') <> earlier AS gone
  FROM f, steps),
counted AS (
  SELECT part, filter_order, step, l,
         count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed,
         count(*) FILTER (gone AND failing) AS redundant, count(*) FILTER (fails = l) AS unique_fails,
         count(*) FILTER (NOT gone AND failing AND good) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, l)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counted
"""
