"""Each stage of the pipeline against plain Python on the stage's own input."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF
from graphloom.llm import mixing, pieces, pii, quality, simhash
from graphloom.session import cut, table


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_stay_those_of_documents(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert stages[-1].columns[:3] == ["doc_id", "n_bytes", "n_tokens"]


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeats = len({p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)})
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if len(words) < 50 or 100 * repeats > 50 * len(words):
        return False
    mean = sum(map(len, words)) / len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text)) / len(words)
    stops = sum(w.lower() in quality.STOP_WORDS for w in words) / len(words)
    return 2 <= mean <= 15 and symbols <= 0.2 and stops >= 0.01 and (len(lines) - len(set(lines))) / len(lines) <= 0.5


def test_quality_stage(stages):
    assert sorted(rows(stages[1])) == sorted(r for r in rows(stages[0]) if good(r[1]))


def test_near_dedup_stage(stages):
    docs = sorted(rows(stages[1]))
    prints = [simhash.fingerprint(r[1]) for r in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    assert sorted(rows(stages[2])) == [r for i, r in enumerate(docs) if root[i] == i]


def test_personal_data_stage(stages):
    field = pii.train()
    want = []
    for doc_id, text, lang, source, _ in rows(stages[2]):
        masked = pii.mask(text, pii.all_spans(text, field))
        want.append((doc_id, masked, lang, source, len(masked)))
    assert sorted(rows(stages[3])) == sorted(want)
    assert not any(pii.find_emails(r[1]) for r in want)


def test_mixing_stage(stages, spark):
    docs = rows(stages[3])
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in docs}
    total: dict = {}
    for r in docs:
        total[r[3]] = total.get(r[3], 0) + size[r[0]]
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(total.items()), "source string, source_size long")).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    want = []
    for source in total:
        whole, at = int(targets[source]), 0
        full = whole // total[source]
        for r in sorted((r for r in docs if r[3] == source), key=lambda r: md5(f"{r[0]}:{md5(r[1])}")):
            part = max(0, min(size[r[0]], whole - full * total[source] - at))
            want += [r] * (full + (part > 0 and 2 * part >= size[r[0]]))
            at += size[r[0]]
    assert sorted(rows(stages[4])) == sorted(want)


def test_last_stage_round_trips(stages):
    segmenter = pieces.Segmenter(open(pieces.MODEL, "rb").read())
    texts = {r[0]: r[1] for r in rows(stages[4])}
    for r in stages[5].collect():
        ids, ends = next(segmenter.encode([texts[r.doc_id]])) if len(texts[r.doc_id]) < pieces.GROUP else (None, None)
        assert r.lossless and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        if ids is not None:
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    good_text = "The house by the river is old and the garden of the mill is in the shade of a hill , so that it was cold there on most days of the year . " \
        "They went to town by boat with bread , wine , salt and a letter for the mayor ; she read it at noon and gave no answer to anyone at all ."
    mail = good_text.replace("a letter", "a.b@c.org")
    rows = [(1, good_text, "en", None, 3), (1, good_text, "en", None, 3), (None, mail, None, "s", None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, mail, "en", "s", None),
            (5, ("Long day . " + mail + " ") * 1 + " ".join(f"w{i} of the" for i in range(9000)), "en", "t", 1), (None, None, None, None, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "_row", "_text", "fp", "key", "size", "position", "spans", "hash", "id", "kept"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_stages_on_odd_rows(spark):
    docs = [odd_documents(spark)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs.append(cut(stage(spark, docs[-1], SF), "test-stage"))
        assert docs[-1].columns == docs[0].columns
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    assert ids(docs[1]) == ["1", "1", "4", "5", "None"]
    assert ids(docs[2]) == ["1", "4", "5", "None"]
    masked = {str(r.doc_id): (r.text, r.n_chars) for r in docs[3].collect()}
    assert all("[EMAIL]" in masked[k][0] for k in ("4", "5", "None")) and all(len(t) == n for t, n in masked.values())
    assert set(ids(docs[4])) <= set(ids(docs[3]))
    last = corpus_pipeline.STAGES[-1][1](spark, docs[4], SF).collect()
    assert len(last) == docs[4].count() and all(r.lossless for r in last)


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path):
    import pathlib

    from graphloom.session import scratch, shared_dir

    at = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "graphloom"
    before = set(at.iterdir())
    with scratch():
        corpus_pipeline.run(spark, SF).write.parquet(f"{tmp_path}/out")
    assert set(at.iterdir()) == before and spark.read.parquet(f"{tmp_path}/out").count() > 50
