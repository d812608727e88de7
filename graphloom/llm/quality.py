"""Quality rules: a threshold table compiled into one Spark projection.

``measure`` derives the counts of a text with array and string built-ins only:
no user function, no shuffle, one pass. Repeated three-word windows are found
by sorting the 64-bit hashes of a text's windows with their positions, so a
very long text costs n log n and no other row waits for it. Two different
windows of one text with the same hash would count as a repeat: the chance is
below 1e-9 for a text of 100,000 words.

``compile_rules`` turns the threshold table into a column of failed rule
names. Each rule is a ratio of two measured columns with an inclusive range.

Defined results: a null or blank text has zero counts, fails the base rule and
is not kept. Repeated rows are measured each for itself. Other columns pass
through untouched; measured columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import SPACE, words

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "auf das dem den der die ein eine für ist mit nicht sich sie und von zu "
    "como con del el los las para por se su una y"
).split()

SYMBOLS = "#*$%&|<>"
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a bound of None is open."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. They are loose: a rule rejects only what no
#: running text in a language with function words looks like. Where bars or
#: other symbols stand alone as words, as in tables and menus, the ratio of
#: symbols to words tends to 0.5 from below, so its bound has to be well under that.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _repeat_words(sorted_windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    def twin(x: Column, i: Column) -> Column:
        before = F.get(sorted_windows, i - 1)["h"]
        after = F.get(sorted_windows, i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    starts = F.array_sort(F.transform(F.filter(sorted_windows, twin), lambda x: x["p"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, p: F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - p)).alias("n"), (p + 3).alias("end")),
        lambda acc: acc["n"],
    ).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES."""
    kept = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    step = docs.select(*kept, words(F.col(text_col)).alias("_w"), lines.alias("_l"))
    step = step.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            F.size("_w") >= 4,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        ).alias("_h"),
    )
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(repeated, F.sort_array(pairs)))
    return step.withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("_s")), F.lit(0)).cast("long")).drop("_h", "_s")


def compile_rules(rules=RULES) -> Column:
    """The names of the rules that a measured row breaks, in table order."""
    def broken(rule: Rule) -> Column:
        ratio = F.col(rule.numerator) / F.nullif(F.col(rule.denominator).cast("double"), F.lit(0.0))
        low = ratio < rule.low if rule.low is not None else F.lit(False)
        high = ratio > rule.high if rule.high is not None else F.lit(False)
        return F.when(F.coalesce(low | high, F.lit(False)), F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


def apply_rules(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    base = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measure(docs, text_col).withColumn("base_failed", base).withColumn("failed_rules", compile_rules(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    # A filter would be pushed below the projection and measure everything anew
    # for each use of a measure; a generator of no or one row is not.
    return apply_rules(whole, rules, "_text").select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = apply_rules(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


_IN = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS tri
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM t WHERE len(w) >= 3)),
rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, tri) AS n FROM win),
cov AS (
  SELECT rid, count(DISTINCT q) AS n
  FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep WHERE n >= 2) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_IN})))::BIGINT AS n_stop_words
  FROM t LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',',
           CASE WHEN word_chars / nullif(n_words, 0) < 2 OR word_chars / nullif(n_words, 0) > 15 THEN 'mean_word_length' END,
           CASE WHEN n_symbols / nullif(n_words, 0) > 0.2 THEN 'symbols_per_word' END,
           CASE WHEN n_stop_words / nullif(n_words, 0) < 0.01 THEN 'stop_word_ratio' END,
           CASE WHEN n_dup_lines / nullif(n_lines, 0) > 0.5 THEN 'duplicate_line_ratio' END) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, failed_rules
FROM b
"""
