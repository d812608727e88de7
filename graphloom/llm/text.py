"""Text expressions that several operators share; all are Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of ``text`` in order; an empty array for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def draw(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, those with the least keyed hash of ``key``; all if there are fewer.

    A count first tells about which hashes can be among them, so that the final
    top-k gets little more than ``n`` rows however many tasks there are.
    """
    total = rows.count()
    share = min(1.0, (1.2 * n + 100) / max(total, 1))
    hashed = F.xxhash64(key, F.lit(seed))
    few = rows if share >= 1.0 else rows.where(hashed <= F.lit(int(share * 2**64) - 2**63).cast("long"))
    return few.orderBy(hashed, *(c for c in rows.columns if c != "text")).limit(n)
