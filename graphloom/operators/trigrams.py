"""An index of trigrams: substrings in any number of texts, without reading the texts.

``build`` numbers the nodes and writes, for each field, in which nodes each three
letters in a row stand: rows (gram, field, block, numbers), a block being ``WIDTH`` node numbers
and so the most that a row holds, counted from the block's first. Nodes are kept in
order of their numbers, so a task gathers most of a row by itself, and only what it has gathered
is shuffled. Each file is sorted by gram, so that a filter on grams reads few row groups. Fields are
taken in lower case, and each ends with two ``END`` letters, so that what is shorter than three
letters is the beginning of some gram.

``found`` takes a table of words: the blocks of each word's grams are intersected (united, for short words), and
the nodes that are left are verified on their texts. All words go in one job. ``search`` is
one needle, whose grams are a filter on the files; ``slices`` are the context slices of any number of questions.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import kind_rank
from graphloom.operators import retrieval
from graphloom.session import cut, fresh_dir, read_numbered, write_numbered

#: Node numbers of a block, and numbers that a task gathers before it passes them on.
WIDTH, GATHERED = 1 << 14, 1_000_000
END = "\u0000"
#: Fields: name, path, a summary that isn't clamped, and of one that is its head, for questions, and the whole, for searches.
NAME, PATH, SHORT, HEAD, WHOLE = range(5)
SEARCHED, ASKED = (NAME, PATH, SHORT, WHOLE), (NAME, PATH, SHORT, HEAD)
#: What a term counts in a field.
COUNTS = {NAME: 3, PATH: 2, SHORT: 1, HEAD: 1}


def _grams(text: str) -> set[str]:
    padded = text + 2 * END
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def grams(text: Column) -> Column:
    """The distinct three letters in a row of a text that ends with two END letters; none for null."""
    @F.pandas_udf("array<string>")
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[] if t is None else sorted(_grams(t)) for t in texts], dtype=object)

    return cut_up(text)


def _gathered(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Rows (gram, field, block, numbers) of the texts (field, number, text) that come one after the other, ``GATHERED`` numbers at a time."""
    held: dict[tuple, array] = {}
    n = 0

    def rows() -> pd.DataFrame:
        gram, field, block = zip(*held)
        return pd.DataFrame({"gram": gram, "field": field, "block": block, "numbers": pd.Series([np.frombuffer(p, np.int16) for p in held.values()], dtype=object)})

    for batch in batches:
        for field, number, text in zip(batch["field"].tolist(), batch["number"].tolist(), batch["text"].tolist()):
            block, place = divmod(number, width)
            for gram in _grams(text):
                key = gram, field, block
                if key not in held:
                    held[key] = array("h")
                held[key].append(place)
                n += 1
            if n >= GATHERED:
                yield rows()
                held, n = {}, 0
    if held:
        yield rows()


def needle_grams(word: str) -> list[str]:
    """The grams that hold every text with ``word`` in it; a short word is the beginning of one."""
    return sorted({word[i : i + 3] for i in range(len(word) - 2)})


def field_texts(nodes: DataFrame) -> DataFrame:
    """``nodes`` with what is looked for in each field, in lower case, as ``texts`` (field, text)."""
    clamped, whole = F.length("summary") > retrieval.SUMMARY, F.lower("summary")
    head = F.lower(retrieval.clamp(F.col("summary"), retrieval.SUMMARY))
    pairs = ((NAME, F.lower("name")), (PATH, F.lower("path")), (SHORT, F.when(~clamped, whole)), (HEAD, F.when(clamped, head)), (WHOLE, F.when(clamped, whole)))
    return nodes.withColumn("texts", F.array(*(F.struct(F.lit(k).alias("field"), text.alias("text")) for k, text in pairs)))


@dataclass
class Index:
    """The folders of an index."""

    spark: SparkSession
    path: str

    @property
    def nodes(self) -> DataFrame:
        return read_numbered(self.spark, f"{self.path}/nodes")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")


def build(nodes: DataFrame, path: str | None = None) -> Index:
    """Index the names, paths and summaries of ``nodes``, whose ids must be distinct."""
    spark = nodes.sparkSession
    path = path or fresh_dir(spark, "trigrams")
    write_numbered(field_texts(nodes.select("node_id", "kind", "name", "path", "summary")).drop("path", "summary"), f"{path}/nodes", "node_id")
    each = Index(spark, path).nodes.select("number", F.inline("texts")).where("text IS NOT NULL").select("field", "number", "text")
    width = WIDTH
    lists = each.mapInPandas(lambda batches: _gathered(batches, width), "gram string, field int, block long, numbers array<smallint>")
    # A gram stands in a field of a node once, so its lists are short beside the whole.
    lists = lists.groupBy("gram", "field", "block").agg(F.array_sort(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    lists.sortWithinPartitions("gram", "field", "block").write.parquet(f"{path}/postings")
    return Index(spark, path)


def _number(place: str) -> Column:
    return F.col("block") * WIDTH + F.col(place)


def _both(lists: Column) -> Column:
    """The numbers that all lists have."""
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(1))), F.get(lists, F.lit(0)), lambda a, b: F.array_intersect(a, b))


def _verified(index: Index, tried: DataFrame) -> DataFrame:
    """(word, field, number) of those ``tried`` whose field really holds the word."""
    texts = index.nodes.select("number", F.inline("texts"))
    return tried.join(texts, ["number", "field"]).where(F.contains("text", F.col("word"))).select("word", "field", "number")


def found(index: Index, words: DataFrame, fields: tuple[int, ...] = SEARCHED) -> DataFrame:
    """(word, field, number): the fields of nodes that hold each of ``words`` (word), lower-case and not empty."""
    words = cut(words.where("word <> ''").select("word").distinct(), "trigram-words")
    postings = index.postings.where(F.col("field").isin(*fields))
    inner = F.filter(grams(F.col("word")), lambda g: F.instr(g, END) == 0)
    asked = words.where(F.length("word") >= 3).select("word", inner.alias("_grams")).select("word", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    met = asked.join(postings, "gram").groupBy("word", "field", "block").agg(F.first("_n").alias("_n"), F.collect_list("numbers").alias("_lists"))
    tried = met.where(F.size("_lists") == F.col("_n")).select("word", "field", "block", F.explode(_both(F.col("_lists"))).alias("_place"))
    tried = tried.select("word", "field", _number("_place").alias("number"))
    for size in (1, 2):
        short = words.where(F.length("word") == size).withColumn("_begin", F.col("word"))
        begun = postings.withColumn("_begin", F.substring("gram", 1, size)).join(F.broadcast(short.limit(100_000)) if size == 1 else short, "_begin")
        tried = tried.unionByName(begun.select("word", "field", "block", F.explode("numbers").alias("_place")).select("word", "field", _number("_place").alias("number")).distinct())
    return _verified(index, tried)


def search(index: Index, needle: str) -> DataFrame:
    """(node_id, name) of nodes with ``needle`` in name, path or summary; a blank one finds none.

    The needle's grams are literals of a filter, so that only row groups that may hold them are read.
    """
    want = needle.strip().lower()
    postings = index.postings.where(F.col("field").isin(*SEARCHED))
    if len(want) >= 3:
        asked = needle_grams(want)
        met = postings.where(F.col("gram").isin(asked)).groupBy("field", "block").agg(F.collect_list("numbers").alias("_lists"))
        tried = met.where(F.size("_lists") == len(asked)).select("field", "block", F.explode(_both(F.col("_lists"))).alias("_place"))
    else:
        tried = postings.where(F.col("gram").startswith(want) & F.lit(want != "")).select("field", "block", F.explode("numbers").alias("_place")).distinct()
    tried = tried.select("field", _number("_place").alias("number"))
    hits = _verified(index, tried.withColumn("word", F.lit(want))).select("number").distinct()
    return index.nodes.join(hits, "number", "left_semi").select("node_id", "name")


def slices(index: Index, questions: DataFrame, cited: DataFrame | None = None, most: int = retrieval.SLICE) -> DataFrame:
    """(item_id, rank, node_id, score): the context slice of each of ``questions`` (item_id, text), in one job.

    Each distinct term is looked up once for all questions. A question's slice is its cited nodes, then
    those with a score, then the first of the rest, of which at most ``most`` can be among them:
    the first nodes of all, beyond as many as could be cited or scored, stand for these.
    ``cited`` is (item_id, node_id, cite_rank), least first.
    """
    asked = cut(questions.select("item_id", F.explode(retrieval.terms(F.col("text"))).alias("word")), "slice-terms")
    counts = F.coalesce(*(F.when(F.col("field") == field, n) for field, n in COUNTS.items()))
    best = found(index, asked, ASKED).groupBy("word", "number").agg(F.max(counts).alias("weight"))
    scored = asked.join(best, "word").groupBy("item_id", "number").agg(F.sum("weight").cast("int").alias("score"))
    nodes = index.nodes.select("number", "node_id", kind_rank(F.col("kind")).alias("kind_rank"))
    none = F.lit(None).cast("long").alias("cite_rank")
    rows = scored.select("item_id", "number", "score", none)
    if cited is not None:
        first = cited.groupBy("item_id", "node_id").agg(F.min("cite_rank").cast("long").alias("cite_rank"))
        rows = rows.unionByName(first.join(nodes.select("node_id", "number"), "node_id").select("item_id", "number", F.lit(0).alias("score"), "cite_rank"))
    # Of the first ``most`` nodes those with a score are placed by it; the others fill up, and no later node is needed.
    fill = nodes.orderBy("kind_rank", "node_id").limit(most).select("number")
    rows = rows.unionByName(questions.select("item_id").crossJoin(F.broadcast(fill)).select("item_id", "number", F.lit(0).alias("score"), none))
    rows = rows.groupBy("item_id", "number").agg(F.max("score").alias("score"), F.min("cite_rank").alias("cite_rank")).join(nodes, "number")
    order = Window.partitionBy("item_id").orderBy(F.col("cite_rank").asc_nulls_last(), F.desc("score"), "kind_rank", "node_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("item_id", "rank", "node_id", "score")


def answers(index: Index, questions: DataFrame, cited: DataFrame | None = None, provider=None) -> DataFrame:
    """(item_id, status, answer, citations) of a table of questions (item_id, text), whose ids are distinct.

    A question that is blank or too long is refused. ``provider`` is a function of (question, context
    ids) that returns (text, citations) and is called in the tasks; without one the slice is the
    answer. Citations of nodes that were not shown are dropped, and nothing is collected.
    """
    checked = retrieval.validated(questions).join(questions.select("item_id", "text"), "item_id")
    good = checked.where("status = 'ok'").select("item_id", "text")
    shown = slices(index, good, cited).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id"))).alias("_s"))
    ready = checked.join(shown.select("item_id", F.col("_s.node_id").alias("shown")), "item_id", "left")

    def reply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item_id, status, text, ids in batch[["item_id", "status", "text", "shown"]].itertuples(index=False):
                ids = [] if ids is None else list(ids)
                said, named = (None, []) if status != "ok" else provider(text, ids) if provider else ("", ids)
                rows.append((item_id, status, said, list(dict.fromkeys(c for c in named if c in ids))))
            yield pd.DataFrame(rows, columns=["item_id", "status", "answer", "citations"])

    item = questions.schema["item_id"].dataType.simpleString()
    return ready.mapInPandas(reply, f"item_id {item}, status string, answer string, citations array<string>")
