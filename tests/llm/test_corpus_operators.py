"""Filter audit, target resampling and substring dedup against plain Python."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from graphloom.llm import audit, coding, queries, resample, substrings
from graphloom.session import table

DOCS = "doc_id long, text string, lang string, source string"
SPACE = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(SPACE, text or "")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("The the of river stone ÉTÉ 漢 x9 A & 12".split()) for _ in range(n))
    passage, line = prose(60), prose(9)
    rows = [
        (1, prose(30) + " " + passage, "en", "a"), (2, passage + "\n" + prose(20), "en", None), (3, None, None, None), (4, "", "", "b"),
        (None, passage, "de", "b"), (None, None, None, None), (5, " \n\t\x00", "de", "c"), (6, prose(4000), "en", "c"),
        (7, passage, "fr", "c"), (7, passage, "fr", "c"), (7, passage + " tail", "en", "d"), (8, passage, "de", "d"),
        (9, (line + "\n") * 40, "en", "e"), (10, "SHOUT " * 120, "en", "e"), (11, line + "\n" + prose(50) + "\n" + line, "en", "e"),
        (12, passage.replace("river", "rivers", 1), "en", "e"), (13, passage[: len(passage) // 2], "en", "e"), (-4, passage[40:], "en", "e"),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("part", "fails", "row", "rank", "score", "number", "block", "key", "size", "uri", "kept", "n_words", "bucket", "_text", "_row"):
        df = df.withColumn(name, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, None, 1), (2, 0, 0), (7, 1, 0), (8, None, None), (None, 1, 1), (10, 0, 1), (99, 1, 1)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, good string")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_target_resampling", "op13_substring_dedup"])
def test_empty_tables(spark, odd, labels, name):
    none = odd.where("false")
    run = {
        "op11_filter_audit": lambda d: audit.query(d, labels.where("false")), "op12_target_resampling": lambda d: resample.query(d, none),
        "op13_substring_dedup": substrings.query,
    }[name]
    assert run(none).collect() == []
    assert run(odd).count() == (odd.count() if not name.startswith("op11") else 600 * 4)
    assert name in queries.QUERIES and name in queries.ORACLE_SQL


def plain_audit(docs, labels):
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    seen = {}
    for r in docs:
        if r.doc_id is not None:
            seen[r.text or ""] = min(r.doc_id, seen.get(r.text or "", r.doc_id))
    out = {}
    for r in docs:
        text, w, part = r.text or "", words(r.text), r.lang or ""
        fails = "".join(c for c, failed in {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": r.doc_id is not None and r.doc_id > seen.get(text, r.doc_id),
        }.items() if failed)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 6)
                failing = letter in fails
                removed = failing and not gone
                for i, hit in enumerate((not gone and not failing, removed, failing and gone, fails == letter, removed and r.doc_id in good, removed and r.doc_id in toxic)):
                    row[i] += hit
                gone |= failing
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return [(*k, *row, total[k[0], k[1][k[2] - 1]]) for k, row in out.items()]


def test_audit_against_a_plain_replay(spark, odd, labels):
    got = [tuple(r) for r in audit.query(odd, labels).collect()]
    same(got, plain_audit(odd.select("doc_id", "text", "lang").collect(), labels.collect()))


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_resampling_against_plain_python(spark, odd):
    docs = odd.select("doc_id", "text").collect() + table(spark, SF, "documents").select("doc_id", "text").collect()
    target = [r.text for r in table(spark, SF, "benchmark").collect()] + [None, ""]
    have, want = np.zeros(10000, int), np.zeros(10000, int)
    for rows, total in ((map(lambda r: r.text, docs), have), (target, want)):
        for text in rows:
            np.add.at(total, plain_features(text)[1], 1)
    gain = [math.floor(1000 * math.log(float(t + 1) * (have.sum() + 10000) / (float(s + 1) * (want.sum() + 10000)))) for s, t in zip(have, want)]
    rows = []
    for r in docs:
        n, buckets = plain_features(r.text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([r.doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    eligible = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(eligible, 1):
        r.append(place if place <= 5 * len(eligible) // 100 else None)
    given = spark.createDataFrame([tuple(r) for r in docs], "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in resample.query(given, spark.createDataFrame([(t,) for t in target], "text string")).collect()]
    plain = [tuple((r + [None])[i] for i in (0, 1, 2, 3, 5)) for r in rows]
    same([g[:4] for g in got], [p[:4] for p in plain])
    # Rows of one id and score can swap ranks.
    same([(g[3], g[4]) for g in got if g[4]], [(p[3], p[4]) for p in plain if p[4]])
    out = resample.drawn(given, spark.createDataFrame([(t,) for t in target], "text string"), share=50)
    assert out.columns == given.columns and out.count() == 50 * len(eligible) // 100


@pytest.mark.parametrize("stretch", [1 << 20, 50])
def test_runs_and_crcs_against_plain_hashing(monkeypatch, stretch):
    monkeypatch.setattr(resample, "STRETCH", stretch)
    rng = random.Random(3)
    texts = [None, "", "  ", "A b c a B c", "é漢 é漢 x!x", "a-b a-b a", "w " * 50, " ".join(rng.choice("the of and a zoo été Wort x9".split()) for _ in range(700)), "x" * 70000 + " tail"]
    total = np.zeros(10000, np.int64)
    resample.count_block(pa.array(texts), 10000, total)
    features = [plain_features(t)[1] for t in texts]
    assert (total == np.bincount(sum(features, []), minlength=10000)).all()
    gains = np.arange(10000) - 3000
    n, n_features, weight = resample.weigh_block(pa.array(texts), gains)
    assert list(weight) == [sum(int(gains[b]) for b in f) for f in features] and list(n_features) == list(map(len, features))


def test_every_run_is_hashed_once(monkeypatch):
    hashed = []
    start = resample.Crc.start
    monkeypatch.setattr(resample.Crc, "start", lambda self, word: hashed.append(len(word)) or start(self, word))
    resample.count_block(pa.array(["a b c " * 100, "a b c"]), 10000, np.zeros(10000, np.int64))
    assert hashed == [3, 3, 3]  # a, b, c; ab, bc, ca; abc, bca, cab


def test_blocks_hold_all_rows_and_words_stay_in_their_text():
    texts = pa.array(["one two", None, "", "x" * 50, "three", "four five"])
    assert list(coding.blocks(texts, 10)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    numbers, found, counts = coding.coded_words(pa.array(["ab", "cd ab", None, " ab", "é"]).slice(1), substrings.INSIDE)
    assert [found[i].decode() for i in numbers] == ["cd", "ab", "ab", "é"] and list(counts) == [2, 0, 1, 1]


def plain_dedup(docs):
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - 12) if doc_id is not None else ():
            key = tuple(w[i : i + 13])
            first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for doc_id, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - 12) if doc_id is not None else ():
            if first[tuple(w[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_dedup_of_odd_rows(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same([tuple(r) for r in substrings.query(odd).collect()], plain_dedup(docs))


@pytest.mark.parametrize("seed, block, stretch", [(1, 1, 1 << 20), (2, 3000, 64), (3, 1 << 20, 13)])
def test_dedup_of_woven_texts(spark, monkeypatch, seed, block, stretch):
    """Passages cut, joined, edited and repeated within and across documents, so that factors
    end everywhere and windows lie across two references; blocks of one document and of all."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(6)) for _ in range(rng.randrange(13, 60))] for _ in range(12)]
    docs = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            piece = list(p[a : a + rng.randrange(5, 50)])
            if piece and rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = "edit" + str(rng.randrange(30))
            w += piece if rng.random() < 0.8 else ["a1"] * rng.randrange(30)
        docs.append((rng.choice([None, *range(-20, 120)]), " ".join(w)))
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_dedup(docs)
    assert sum(r[2] for r in want) > 1000
    same([tuple(r) for r in substrings.query(given).collect()], want)


def test_long_factors_leave_few_windows_to_compare():
    """A copy is a factor from its first to its last anchor; only what lies at its ends is compared."""
    rng = random.Random(9)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(5000))
    block = substrings.Block(pa.array([1, 2]), pa.array([text, text]))
    n = len(block.places) // 2
    told = {"key": block.anchors[:n], "first_doc": np.ones(n, np.int64), "first_block": np.zeros(n, np.int64), "first_place": block.places[:n]}
    begin, end, places = block.told(told)
    assert len(begin) == 1 and end[0] - begin[0] > 4980 and (places >= 5013).sum() <= 24


def test_a_common_passage_is_one_row_a_block(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(" ".join(map(str, range(30)))).alias("text"))
    block = substrings.Block(pa.array(range(400)), pa.array([r.text for r in docs.collect()]))
    rows = substrings._entries(0, block.anchors, np.zeros_like(block.anchors), block.ids[block.documents(block.places)], block.places)
    assert rows.num_rows == len(block.places) // 400 and set(rows.column("low").to_pylist()) == {0} and set(rows.column("high").to_pylist()) == {399}
