"""Search, term scores, context slices, conversation clamps and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import kind_rank

#: Words that are no terms.
STOPWORDS = (
    "and any are but can did does for from get has have how into its not the that them then there these they this was "
    "were what when where which who why will with you your"
).split()
SLICE, SUMMARY, QUESTION, ANSWER, TURNS, CITATION = 40, 400, 1000, 2000, 6, 500
MIN_TERM = 3


def clamp(text: Column, most: int) -> Column:
    """The first ``most`` characters and an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def terms(question: Column) -> Column:
    """Distinct sorted words of a question without stop words."""
    words = F.split(F.lower(question), r"[^\p{IsAlphabetic}\p{N}]+")
    kept = F.filter(words, lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(*STOPWORDS))
    return F.array_sort(F.array_distinct(kept))


def term_score(words: Column, name: Column, path: Column, summary: Column) -> Column:
    """Each term counts once, at its strongest field: name 3, path 2, summary 1."""
    low_name, low_path, low_summary = F.lower(name), F.lower(path), F.lower(summary)
    one = lambda t: F.when(F.contains(low_name, t), 3).when(F.contains(low_path, t), 2).when(F.contains(low_summary, t), 1).otherwise(0)
    return F.aggregate(F.transform(words, one), F.lit(0), lambda a, b: a + b)


def search(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes with ``needle`` in name, path or summary; a blank one finds none."""
    want = F.lit(needle.strip().lower())
    hit = F.contains(F.lower("name"), want) | F.contains(F.lower("path"), want) | F.contains(F.lower("summary"), want)
    return nodes.where(hit & (want != "")).select("node_id", "name")


def scored_nodes(nodes: DataFrame, question: str) -> DataFrame:
    """(node_id, kind, score); summaries are clamped before they are read."""
    words = terms(F.lit(question))
    points = term_score(words, F.col("name"), F.col("path"), clamp(F.col("summary"), SUMMARY))
    return nodes.select("node_id", "kind", points.cast("int").alias("score"))


def context_slice(nodes: DataFrame, question: str, cited: DataFrame | None = None, most: int = SLICE) -> DataFrame:
    """(rank, node_id, score): cited nodes first, then by score, kind and id.

    ``cited`` is (node_id, cite_rank), least first. One top-k over both groups:
    each task keeps ``most`` rows.
    """
    scored = scored_nodes(nodes, question)
    if cited is None:
        scored = scored.withColumn("cite_rank", F.lit(None).cast("long"))
    else:
        first = cited.groupBy("node_id").agg(F.min("cite_rank").cast("long").alias("cite_rank"))
        scored = scored.join(first, "node_id", "left")
    order = [F.col("cite_rank").asc_nulls_last(), F.desc("score"), kind_rank(F.col("kind")), F.col("node_id")]
    best = scored.orderBy(*order).limit(most)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "node_id", "score")


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user messages with the assistant message that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    paired = paired.where("role = 'user' AND next_role = 'assistant'")
    return paired.select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))


def clamped_turns(talk: DataFrame, most: int = TURNS) -> DataFrame:
    """The newest turns of each conversation, question and answer clamped.

    A column ``citations``, if there, keeps its first ``SLICE`` ids, each clamped.
    """
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = talk.withColumn("_newest", newest).where(F.col("_newest") <= most)
    cited = [F.transform(F.slice("citations", 1, SLICE), lambda c: clamp(c, CITATION)).alias("citations")] if "citations" in talk.columns else []
    return kept.select("conv_id", "turn", clamp(F.col("question"), QUESTION).alias("question"), clamp(F.col("answer"), ANSWER).alias("answer"), *cited)


def carried(messages: DataFrame, most: int = TURNS) -> DataFrame:
    """(conv_id, turns, in_flight): what a conversation sends along with its next question.

    ``turns`` are the newest completed exchanges, clamped, the oldest of them first; a user
    message that is the last one and has no answer is in flight, and no other is sent before it has.
    """
    done = clamped_turns(turns(messages), most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("turns"))
    last = messages.groupBy("conv_id").agg(F.max_by("role", "turn").alias("_role"))
    none = F.array().cast("array<struct<turn:" + messages.schema["turn"].dataType.simpleString() + ",question:string,answer:string>>")
    joined = last.join(done, "conv_id", "left")
    return joined.select("conv_id", F.coalesce("turns", none).alias("turns"), (F.col("_role") == "user").alias("in_flight"))


def validated(questions: DataFrame) -> DataFrame:
    """(item_id, status): blank and over-long questions are refused."""
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r\x0b\f"))
    status = F.when(text == "", "the question is empty").when(
        F.length(text) > QUESTION, F.concat(F.lit("the question is "), F.length(text), F.lit(f" characters; the limit is {QUESTION}"))
    ).otherwise("ok")
    return questions.select("item_id", status.alias("status"))


def verified(citations: DataFrame, shown: DataFrame) -> DataFrame:
    """(pos, node_id): citations of shown nodes, the first occurrence of each."""
    kept = citations.join(shown.select("node_id").distinct(), "node_id", "left_semi")
    return kept.groupBy("node_id").agg(F.min("pos").alias("pos"))


def usage_total(talk: DataFrame) -> DataFrame:
    """(conv_id, input_tokens, output_tokens) of conversations of several turns, all measured."""
    sums = talk.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()).alias("measured"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    return sums.where("n > 1 AND n = measured").select("conv_id", "input_tokens", "output_tokens")


def _listed(first: Column, n: Column) -> Column:
    """Up to three names, and how many more there are."""
    shown = F.size(first)
    more = F.concat(F.array_join(first, ", "), F.lit(", and "), n - 3, F.lit(" more"))
    both = F.concat(F.array_join(F.slice(first, 1, F.greatest(shown - 1, F.lit(1))), ", "), F.lit(" and "), F.get(first, shown - 1))
    return F.when(n > 3, more).when(shown <= 1, F.get(first, F.lit(0))).otherwise(both)


def first_names(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, first): number of distinct names and the first three of them.

    Names are ordered by the least ``seq`` at which each appears. Only three
    leave the window, however many a key has. Rows are dealt out by the keys once,
    and names are made distinct, ranked and counted where they are.
    """
    distinct = pairs.repartition(*keys).groupBy(*keys, "name").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "name"))
    shown = F.when(F.col("_r") <= 3, F.struct("_r", "name"))
    counted = distinct.withColumn("_r", rank).groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(shown)).alias("_h"))
    return counted.select(*keys, "n", F.col("_h.name").alias("first"))


def narratives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, narrative): what each file holds, is reached by and reaches.

    Names come imports first, then calls, each by the other end's id. The three
    ways are one table, keyed by node and way, and its names are joined once.
    """
    names = nodes.select(F.col("node_id").alias("other"), "name")
    ways = ("inbound", "outbound", "held")
    end = lambda way, node, other: F.struct(F.lit(way).alias("way"), F.col(node).alias("node_id"), F.col(other).alias("other"))
    both = F.array(end("inbound", "target", "source"), end("outbound", "source", "target"))
    ends = F.when(F.col("kind") == "contains", F.array(end("held", "source", "target"))).otherwise(both)
    k = F.when(F.col("kind").isin("contains", "imports"), 0).otherwise(1)
    pairs = edges.where("kind IN ('imports', 'calls', 'contains')").select(k.alias("k"), F.inline(ends))
    # An id begins with its kind (``model.node_id``), so ends that are symbols go before anything is shuffled.
    pairs = pairs.where(~F.startswith("node_id", F.lit("function:")) & ~F.startswith("node_id", F.lit("class:")))
    of_files = nodes.where("kind = 'file'").select("node_id")
    pairs = pairs.join(names, "other").withColumn("seq", F.struct("k", F.col("other").alias("o")))
    found = first_names(pairs, "node_id", "way")
    by_way = found.groupBy("node_id").agg(*(
        F.max(F.when(F.col("way") == way, F.col(c))).alias(f"{way}_{c}") for way in ways for c in ("n", "first")))
    out = of_files.join(by_way, "node_id", "left")
    # The sentences.
    lists = {way: _listed(F.col(f"{way}_first"), F.col(f"{way}_n")) for way in ways}
    n = F.col("held_n")
    holds = F.when(n > 0, F.concat(F.lit("Holds "), n, F.when(n == 1, " definition: ").otherwise(" definitions: "), lists["held"], F.lit(".")))
    inward = F.when(F.col("inbound_n").isNull(), "Nothing in this map reaches it, so it is a way in.").otherwise(F.concat(F.lit("Reached by "), lists["inbound"], F.lit(".")))
    outward = F.when(F.col("outbound_n").isNull(), "It reaches nothing further — the walk ends here.").otherwise(F.concat(F.lit("It reaches "), lists["outbound"], F.lit(".")))
    alone = F.col("inbound_n").isNull() & F.col("outbound_n").isNull()
    rest = F.when(alone, "Nothing in this map reaches it, and it reaches nothing.").otherwise(F.concat_ws(" ", inward, outward))
    return out.select("node_id", F.concat_ws(" ", holds, rest).alias("narrative"))


def cited_nodes(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pos, node_id, name, missing): citations with the node that they name, if any."""
    named = nodes.select(F.col("node_id").alias("_id"), "name")
    joined = citations.join(named, F.col("node_id") == F.col("_id"), "left")
    return joined.select("pos", "node_id", "name", F.col("_id").isNull().alias("missing"))


def source_lines(texts: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """(key, line, text, lit): numbered lines, those of the range lit."""
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    line = F.col("pos") + 1
    return rows.select(key, line.alias("line"), "text", line.between(first, last).alias("lit"))


def context_slices(nodes: DataFrame, questions: dict[int, str], cited: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, node_id, score): the slice of each question, in one job.

    Questions are few and given by id; ``cited`` is (item_id, node_id, cite_rank).
    """
    out = nodes.sparkSession.createDataFrame([], "item_id long, rank int, node_id string, score int")
    for item_id, text in questions.items():
        own = None if cited is None else cited.where(F.col("item_id") == item_id).select("node_id", "cite_rank")
        out = out.unionByName(context_slice(nodes, text, own).withColumn("item_id", F.lit(item_id).cast("long")))
    return out


#: Questions whose slices are taken in one job.
BLOCK = 32


def ask(nodes: DataFrame, questions: DataFrame, talk: DataFrame | None = None, provider=None) -> list[dict]:
    """Answers to a few questions, ``BLOCK`` of them to a Spark job.

    A question that is blank or too long is refused. The context slice takes the
    clamped turns' citations first. ``provider`` is a function of (question,
    context ids) that returns (text, citations); without one the slice is the
    answer. Citations of nodes that were not shown are dropped.
    """
    out = []
    rows = validated(questions).join(questions.select("item_id", "text"), "item_id").orderBy("item_id").collect()
    for at in range(0, len(rows), BLOCK):
        block = rows[at : at + BLOCK]
        slices: dict[int, list[str]] = {r.item_id: [] for r in block}
        good = {r.item_id: r.text for r in block if r.status == "ok"}
        for r in context_slices(nodes, good, talk).orderBy("item_id", "rank").collect() if good else ():
            slices[r.item_id].append(r.node_id)
        for row in block:
            if row.status != "ok":
                out.append({"item_id": row.item_id, "status": row.status, "answer": None, "citations": []})
                continue
            shown = slices[row.item_id]
            text, citations = provider(row.text, shown) if provider else ("", shown)
            kept = list(dict.fromkeys(c for c in citations if c in shown))
            out.append({"item_id": row.item_id, "status": "ok", "answer": text, "citations": kept})
    return out
