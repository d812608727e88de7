"""Small text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """A safe file name: other characters than letters, digits, dot, dash and
    underscore become dashes, runs are one, and ends are trimmed; ``map`` if empty."""
    dashed = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("map"))


def percent_decoded(value: Column) -> Column:
    """Percent escapes decoded; a plus stays one, and what is no whole escape stays as it is.

    Every other byte is written as two hexadecimal digits and escapes give theirs, so
    that escapes of one character's bytes come together before they are read as text.
    """
    parts = F.regexp_extract_all(value, F.lit("(?s)(%[0-9A-Fa-f]{2}|%|[^%]+)"), 1)
    escape = lambda x: (F.length(x) == 3) & F.startswith(x, F.lit("%"))
    digits = F.transform(parts, lambda x: F.when(escape(x), F.substring(x, 2, 2)).otherwise(F.hex(x)))
    return F.make_valid_utf8(F.unhex(F.array_join(digits, "")).cast("string"))


def caption(summary: Column) -> Column:
    """A node's summary, null if it is empty."""
    return F.nullif(summary, F.lit(""))


def counted(n: Column, noun: str) -> Column:
    """A number and what it counts: 1 file, 2 files."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def subject(n: Column, noun: str, singular: str, plural: str) -> Column:
    """A counted subject with the verb that goes with it."""
    return F.concat(counted(n, noun), F.lit(" "), F.when(n == 1, singular).otherwise(plural))


def enrichment_hint(provenance: Column) -> Column:
    """What a reader of a summary that no provider wrote is told; null for one that a provider wrote."""
    told = "This is read off the structure. Fill the map's open slots for a written explanation of what it does."
    return F.when(provenance.eqNullSafe(F.lit("llm")), F.lit(None).cast("string")).otherwise(told)


def escaped(text: Column) -> Column:
    """HTML text with its five special characters escaped."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def usage(envelope: Column) -> Column:
    """(input_tokens, output_tokens) of a provider's JSON envelope; null unless both are there."""
    get = lambda k: F.get_json_object(envelope, f"$.usage.{k}").try_cast("long")
    both = F.struct(get("input_tokens").alias("input_tokens"), get("output_tokens").alias("output_tokens"))
    return F.when(get("input_tokens").isNotNull() & get("output_tokens").isNotNull(), both)


def thousands(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def civil_date(days: Column) -> Column:
    """Days since 1970-01-01 as ``yyyy-MM-dd``."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
