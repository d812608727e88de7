"""Facts read off texts: Markdown links, symbol ordinals and mechanical summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plural(noun: Column, n: Column) -> Column:
    """The noun for ``n`` things: es after a hissing sound."""
    many = F.when(noun.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es"))).otherwise(F.concat(noun, F.lit("s")))
    return F.when(n == 1, noun).otherwise(many)


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """``symbols`` (path, seq, kind, name) with ``symbol``: repeats of a name in a file get #2, #3."""
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("seq"))
    return symbols.withColumn("symbol", F.when(n > 1, F.concat("name", F.lit("#"), n)).otherwise(F.col("name")))


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a last line without an end counts too."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def file_summary(language: Column, lines: Column, functions: Column, classes: Column) -> Column:
    """``<Language> file, N lines: a functions, b classes``."""
    part = lambda n, noun: F.when(n > 0, F.concat(n, F.lit(" "), plural(F.lit(noun), n)))
    parts = F.concat_ws(", ", part(functions, "function"), part(classes, "class"))
    return F.concat(language, F.lit(" file, "), lines, F.lit(" "), plural(F.lit("line"), lines), F.when(parts != "", F.concat(F.lit(": "), parts)).otherwise(""))


def markdown_links(docs: DataFrame) -> DataFrame:
    """(path, pos, target): inline and reference link targets outside code fences.

    A document's lines stay in its row: fence parity is a running fold over the
    line array, so no window and no shuffle is needed. Targets lose angle
    brackets, fragment and query; absolute paths and schemes are dropped.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    is_fence = lambda x: F.btrim(x).startswith("```") | F.btrim(x).startswith("~~~")
    zero = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))
    fold = lambda s, x: F.struct(
        F.when(is_fence(x), ~s["open"]).otherwise(s["open"]).alias("open"),
        F.when(s["open"] | is_fence(x), s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"))
    shown = F.when(F.contains("text", F.lit("](")) | F.contains("text", F.lit("]:")), F.aggregate(lines, zero, fold, lambda s: s["out"])).otherwise(F.array().cast("array<string>"))
    inline = F.transform(shown, lambda x: F.regexp_extract_all(x, F.lit(r"\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)"), 1))
    named = F.transform(shown, lambda x: F.regexp_extract_all(x, F.lit(r"^\s*\[[^\]]+\]:\s*<?([^\s>]+)>?"), 1))
    found = F.flatten(F.transform(F.arrays_zip(inline.alias("a"), named.alias("b")), lambda z: F.concat(z["a"], z["b"])))
    rows = docs.select("path", F.posexplode(found).alias("pos", "raw"))
    target = F.regexp_replace("raw", r"[#?].*$", "")
    rows = rows.select("path", "pos", target.alias("target"))
    return rows.where((F.col("target") != "") & ~F.col("target").startswith("/") & ~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every anchor in a page, in order."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))
