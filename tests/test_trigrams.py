"""The trigram index against scans."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import retrieval, trigrams


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdéß漢.İ x") for _ in range(rng.randrange(1, 9)))
    rows = []
    for i in range(150):
        kind = rng.choice(["file", "function", "class"])
        summary = rng.choice([None, "", word(), " ".join(word() for _ in range(120)), "Retry Logic " + word()])
        rows.append((f"{kind}:{i:03d}", kind, word(), f"src/{word()}/{i % 7}.py", summary, None, "structural"))
    rows.append(("file:end", "file", "zq", "zq", "tail zq", None, "structural"))
    return spark.createDataFrame(rows, "node_id string, kind string, name string, path string, summary string, layer string, provenance string").cache()


@pytest.fixture(scope="module")
def index(nodes):
    return trigrams.build(nodes)


def test_search_is_the_scans(spark, nodes, index):
    needles = ["a", "zq", "q", "ab", "é", "漢", "Retry LOGIC", " src/ ", "src/", "..", "x a", "İ", "i̇", "…", "no such thing", "", "  ", "il zq", "py", "6.py"]
    for needle in needles:
        want = sorted(r.node_id for r in retrieval.search(nodes, needle).collect())
        assert sorted(r.node_id for r in trigrams.search(index, needle).collect()) == want, needle
    words = [n.strip().lower() for n in needles]
    got = trigrams.found(index, spark.createDataFrame([(w,) for w in words], "word string")).select("word", "number").distinct()
    got = {(r.word, r.node_id) for r in got.join(index.nodes, "number").collect()}
    assert got == {(w, r.node_id) for w in words for r in retrieval.search(nodes, w).collect()}


def test_a_search_filters_the_files_by_its_grams(index):
    plan = trigrams.search(index, "Retry Logic")._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("FileScan") if "numbers" in part.split("]", 1)[0]]
    assert scans and all("In(gram, [" in part for part in scans)


def test_blocks_are_bounded(index, monkeypatch, nodes):
    monkeypatch.setattr(trigrams, "WIDTH", 16)
    small = trigrams.build(nodes)
    assert small.postings.agg(F.max(F.size("numbers"))).head()[0] <= 16 < index.postings.agg(F.max(F.size("numbers"))).head()[0]
    for needle in ("src", "a", "ab", "retry logic"):
        assert sorted(trigrams.search(small, needle).collect()) == sorted(trigrams.search(index, needle).collect())


def test_slices_are_those_of_one_question_at_a_time(spark, nodes, index):
    questions = {1: "Where is the retry logic in src?", 2: "abc? and ßd", 3: "the what how", 4: "", 5: "logic logic LOGIC retry"}
    cited = spark.createDataFrame([(1, "function:001", 3), (1, "file:end", 1), (1, "file:end", 9), (1, "gone", 0), (3, "class:002", 5)], "item_id long, node_id string, cite_rank long")
    table = spark.createDataFrame(list(questions.items()), "item_id long, text string")
    for most in (3, 40, 500):
        got = {}
        for r in trigrams.slices(index, table, cited, most).collect():
            got.setdefault(r.item_id, []).append((r["rank"], r.node_id, r.score))
        for item_id, text in questions.items():
            own = cited.where(F.col("item_id") == item_id).select("node_id", "cite_rank")
            want = [tuple(r) for r in retrieval.context_slice(nodes, text, own, most).collect()]
            # A cited node's score orders it only among equal ranks.
            assert [(a, b) for a, b, _ in sorted(got[item_id])] == [(a, b) for a, b, _ in sorted(want)], (item_id, most)


def test_answers_are_those_of_ask(spark, nodes, index):
    table = spark.createDataFrame([(1, "Where is the retry logic?"), (2, "  "), (3, "x" * 1001), (4, "abc")], "item_id long, text string")
    provider = lambda q, shown: (f"{len(shown)} for {q}", [shown[1], "invented", shown[0], shown[1]])
    for given in (None, provider):
        got = {r.item_id: (r.status, r.answer, list(r.citations)) for r in trigrams.answers(index, table, provider=given).collect()}
        want = {r["item_id"]: (r["status"], r["answer"], r["citations"]) for r in retrieval.ask(nodes, table, provider=given)}
        assert got == want


def test_numbers_are_gathered_before_they_are_shuffled():
    """A task passes on one row for all texts of a block that hold a gram."""
    import pandas as pd

    batch = pd.DataFrame({"field": [0] * 40, "number": range(40), "text": ["abcd"] * 40})
    rows = pd.concat(trigrams._gathered(iter([batch[:25], batch[25:]]), 16))
    got = {(r.gram, r.block): list(r.numbers) for r in rows.itertuples()}
    assert len(rows) == len(got) == 3 * len(trigrams._grams("abcd"))
    assert got["bcd", 2] == list(range(8)) and got["abc", 0] == list(range(16))


def test_numbers_follow_the_order_over_all_ranges(spark):
    from graphloom.session import numbered

    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "concat('t', id) AS t").repartition(7)
    out = numbered(rows, "k")
    assert out.columns == ["k", "t", "number"] and {(r.k, r.number) for r in out.collect()} == {(k, k) for k in range(5000)}
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
    assert numbered(rows.limit(0), "k").count() == 0
