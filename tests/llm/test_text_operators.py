"""Each operator on odd rows, on empty tables and against brute force."""

import gzip
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF
from graphloom.llm import langid, media, mixing, pieces, pii, quality, queries, rollups, simhash, toxicity, warc
from graphloom.session import fresh_dir, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of to in is house river stone window garden letter morning evening paper market".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing extra columns."""
    rng = random.Random(1)
    long = prose(rng, 30000)
    rows = [
        (1, prose(rng, 80), "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "Text without an id.", "en", "b", 3),
        (4, " \n\t ", "de", "b", 4), (5, long, "en", "c", 5), (6, long, "en", "c", 5), (7, "é漢🙂▁ ▁x", "fr", "c", 7),
        (8, "word", "en", None, 8), (8, "word", "en", None, 8), (9, "a b", "fr", "d", 9), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "id", "hash", "row", "n_words", "kept", "spans", "size", "taken", "position", "ids", "_text", "_row", "key", "root", "found"):
        df = df.withColumn(name, F.lit("x"))
    return df.cache()


def asked(name, docs, spark):
    if name.startswith("op7"):
        labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
        return toxicity.query(docs, labels)
    if name.startswith("op10"):
        return warc.query(docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "key"))
    module = {"op1": pieces, "op2": simhash, "op3": media, "op4": quality, "op5": pii, "op6": rollups, "op8": mixing, "op9": langid}
    return module[name.split("_")[0]].query(docs)


#: Operators 11 to 13 have these tests in test_corpus_operators.
@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if not n.startswith(("op11", "op12", "op13"))])
def test_odd_rows_and_empty_tables(spark, odd, name):
    out = asked(name, odd, spark).collect()
    key = "page_id" if name.startswith("op10") else "doc_id"
    if not name.startswith("op6"):
        want = sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
        assert sorted(str(r[key]) for r in out) == want
    assert asked(name, odd.limit(0), spark).count() == 0


# --- op1 ------------------------------------------------------------------------


def plain_agenda(segmenter, word, key):
    """Merge by repeated search, with the same keyed skips."""
    symbols = [segmenter.by_char[ord(c)] for c in word]
    edges = list(range(len(word) + 1))
    table = dict(zip(segmenter.pairs.tolist(), zip(segmenter.rank.tolist(), segmenter.joined.tolist())))
    while True:
        best = None
        for i in range(len(symbols) - 1):
            hit = table.get(int(symbols[i]) << 32 | int(symbols[i + 1]))
            if hit is None:
                continue
            skipped = pieces.candidate_hash(np.uint64(key), *(np.uint64(edges[i + k]) for k in range(3))) < segmenter.limit
            if not (segmenter.rate and skipped) and (best is None or hit[0] < best[0]):
                best = (hit[0], i, hit[1])
        if best is None:
            return symbols
        _, i, piece = best
        symbols[i : i + 2] = [piece]
        del edges[i + 1]


def test_pieces_without_dropout_are_the_librarys():
    import sentencepiece

    data = open(pieces.MODEL, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = pieces.Segmenter(data, 0.0)
    rng = random.Random(2)
    texts = ["", "a", "  two  blanks \n\n", "x" * 300, "<s> <0x0A>", "é漢🙂", *(prose(rng, 50) for _ in range(20)),
             *("".join(rng.choice("abcdeé漢 \n\tz.,") for _ in range(80)) for _ in range(60))]
    at = 0
    for ids, ends in own.encode(texts):
        for t, part in zip(texts[at:], np.split(ids, ends[:-1])):
            assert part.tolist() == sp.encode(t)
        at += len(ends)


def test_long_words_go_through_the_heap():
    import sentencepiece

    data = open(pieces.MODEL, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdehilnorst漢é") for _ in range(3000))
    ids, _ = next(pieces.Segmenter(data, 0.0).encode([long, "x" * 200_000]))
    assert ids.tolist() == sp.encode(long) + sp.encode("x" * 200_000)
    own = pieces.Segmenter(data, 0.3, seed=5)
    word = " " + "".join(rng.choice("abcdehilnorst") for _ in range(400))
    symbols = own.by_char[[ord(c) for c in word]]
    assert own._merge_long(symbols, 99).tolist() == [int(s) for s in plain_agenda(own, word, 99)]
    padded, n = own._merge(symbols[None, :].copy(), np.array([len(symbols)]), np.array([99], np.uint64))
    assert padded[0, : n[0]].tolist() == own._merge_long(symbols, 99).tolist()


def test_dropout_matches_a_plain_agenda_and_varies():
    data = open(pieces.MODEL, "rb").read()
    own = pieces.Segmenter(data, 0.3, seed=5)
    rng = random.Random(4)
    words = [" " + "".join(rng.choice("abcdefghiklmnorst") for _ in range(rng.randint(2, 14))) for _ in range(60)]
    for w in words:
        for v in range(own.variants):
            key = pieces.mix64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 5)) + np.uint64(v * 0x9E3779B97F4A7C15 % 2**64))
            slot = own.slots[w]
            code = np.array([slot * own.variants + v])
            need = len(own.slots) * own.variants
            if need > len(own.start):
                own.start = np.concatenate([own.start, np.full(need, -1, np.int64)])
                own.count = np.concatenate([own.count, np.zeros(need, np.int64)])
            own._learn(code)
            got = own.pool[own.start[code[0]] : own.start[code[0]] + own.count[code[0]]].tolist()
            assert got == [int(s) for s in plain_agenda(own, w, key)]
    ids, ends = next(own.encode([" house" * 200]))
    assert len(set(ids.tolist())) > 3


def test_a_key_for_each_occurrence_against_a_plain_agenda():
    data = open(pieces.MODEL, "rb").read()
    own, rng = pieces.Segmenter(data, 0.2, seed=5, variants=None), random.Random(14)
    texts = [prose(rng, 300), "", "x" * 400 + " end", " house" * 500, prose(rng, 40) + " é漢 ▁x"]
    for _ in range(2):  # the second time from the tables
        ids, ends = next(own.encode(texts))
        for text, got in zip(texts, np.split(ids, ends[:-1])):
            seed, want = xxhash.xxh64_intdigest(text.encode(), 5), []
            for place, word in enumerate(pieces._WORDS.findall(" " + text if own.prefix else text) if text else []):
                key = pieces.mix64(np.uint64((seed + place * 0x9E3779B97F4A7C15) % 2**64))
                for symbol in plain_agenda(own, word, key):
                    want += own.spelled[symbol]
            assert got.tolist() == want
    houses = np.split(ids, ends[:-1])[3]
    assert len({tuple(x) for x in np.split(houses, np.flatnonzero(own.piece_bytes[own.piece_start[houses]] == 32)[1:])}) > pieces.VARIANTS


def test_documents_get_a_key_for_each_occurrence(spark, monkeypatch):
    text = " house" * 800
    ids = pieces.encode(spark.createDataFrame([(text,)], "text string"), rate=0.2).head()["ids"]
    own, want = pieces.Segmenter(open(pieces.MODEL, "rb").read(), 0.2, variants=None), []
    seed = xxhash.xxh64_intdigest(text.encode(), pieces.SEED)
    words = pieces._WORDS.findall(" " + text if own.prefix else text)
    several = set()
    for place, word in enumerate(words):
        got = [i for symbol in plain_agenda(own, word, pieces.mix64(np.uint64((seed + place * 0x9E3779B97F4A7C15) % 2**64))) for i in own.spelled[symbol]]
        several.add(tuple(got))
        want += got
    assert ids == want and len(several) > pieces.VARIANTS + 2
    # The same with few forks, or with candidates beyond those that forks tell apart.
    for name, value in (("FORKS", 3), ("TOLD", 2)):
        monkeypatch.setattr(pieces, name, value)
        assert next(pieces.Segmenter(open(pieces.MODEL, "rb").read(), 0.2, variants=None).encode([text]))[0].tolist() == want


def test_only_words_and_forks_met_again_are_kept():
    own, rng = pieces.Segmenter(open(pieces.MODEL, "rb").read(), 0.2, variants=None), random.Random(15)
    words = sorted({" " + "".join(rng.choice("abcdefghiklmnorst") for _ in range(rng.randint(7, 14))) for _ in range(300)})
    text = "".join(words)
    seed, want = xxhash.xxh64_intdigest(text.encode(), pieces.SEED), []
    for place, word in enumerate(pieces._WORDS.findall(" " + text if own.prefix else text)):
        key = pieces.mix64(np.uint64((seed + place * 0x9E3779B97F4A7C15) % 2**64))
        want += [i for symbol in plain_agenda(own, word, key) for i in own.spelled[symbol]]
    kept = []
    for _ in range(4):
        ids, _ = next(own.encode([text]))
        assert ids.tolist() == want and len(own.slots) == len(own.slots.words)
        kept.append((len(own.slots) > len(words) // 2, bool(own.forks)))
    assert kept == [(False, False), (True, False), (True, True), (True, True)]


@pytest.mark.parametrize("variants", [pieces.VARIANTS, None])
def test_round_trip_through_spark(spark, odd, variants):
    out = pieces.decode(pieces.encode(odd.select("doc_id", "text"), rate=0.2, variants=variants)).collect()
    assert all(r.decoded == r.text for r in out)
    again = pieces.encode(odd.repartition(5).select("doc_id", "text"), rate=0.2, variants=variants).collect()
    assert sorted(map(str, [(r.doc_id, r.ids) for r in out])) == sorted(map(str, [(r.doc_id, r.ids) for r in again]))


# --- op2 ------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_classes_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(docs).collect()}
    assert got == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def inserted(values):
    """Children by distance of a BK-tree to which values are added one after another."""
    children = []
    for i, value in enumerate(values):
        children.append({})
        node = 0
        while i:
            d = (values[node] ^ value).bit_count()
            if d not in children[node]:
                children[node][d] = i
                break
            node = children[node][d]
    return children


def test_tree_search_and_chains(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))) for _ in range(300)})
    tree = simhash.Tree(np.array(values, np.uint64))
    assert [{d: int(c) for d, c in enumerate(row) if c >= 0} for row in tree.child] == inserted(values)
    k, node = tree.search(np.array(values[:40], np.uint64), 2)
    assert sorted(zip(k.tolist(), node.tolist())) == [(i, j) for i, v in enumerate(values[:40]) for j, w in enumerate(values) if (v ^ w).bit_count() <= 2]
    chain = [0]
    for k in range(40):  # each link flips two other bits
        chain.append(chain[-1] ^ (1 << (k % 62)) ^ (1 << (k % 62 + 1)) if k % 2 else chain[-1] ^ (1 << (k % 64)))
    fps = spark.createDataFrame([(simhash._signed(v),) for v in set(chain)], "fp long")
    roots = simhash.components(simhash.near_links(fps)).select("root").distinct().collect()
    assert [r.root for r in roots] == [min(simhash._signed(v) for v in chain)]


def slow_groups(values, radius=2):
    """The least signed value that each one reaches, by all pairs."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    signed, least = values.view(np.int64), values.view(np.int64).copy()
    while True:
        lower = np.where(near, least[None, :], np.iinfo(np.int64).max).min(1)
        if (lower == least).all():
            return {int(a): int(b) for a, b in zip(signed, least)}
        least = lower


def test_hot_shards_are_dealt_again_and_lose_no_link(spark):
    rng = np.random.default_rng(4)
    dense = rng.integers(0, 2**63, dtype=np.uint64) ^ np.unique(rng.integers(0, 2**11, 900, np.uint64))
    values = np.unique(np.concatenate([dense, rng.integers(0, 2**63, 600, np.uint64), dense[:200] ^ (np.uint64(1) << rng.integers(11, 64, 200).astype(np.uint64))]))
    fps = spark.createDataFrame([(simhash._signed(int(v)),) for v in values], "fp long").repartition(6)
    shards = simhash.shards(fps, size=64, most=100)
    sizes = [r.n for r in shards.select(F.size("fps").alias("n")).collect()]
    assert max(sizes) <= 100 and sum(n > 2 for n in sizes) > 5
    links = shards.select("fps").collect()
    made = [pair for r in links for pair in zip(*simhash.shard_links(np.array(r.fps)))]
    least = {int(v): int(v) for v in values.view(np.int64)}
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in made], "u long, v long").distinct()
    least |= {r.node: r.root for r in simhash.components(edges).collect()}
    assert least == slow_groups(values)


def test_links_come_from_trees(spark, monkeypatch):
    """On 10,000 documents shards are trees of hundreds on average, and every link is one that a search found."""
    prints = simhash.fingerprints(table(spark, SF.replace("0.001", "0.1"), "documents")).select("fp").distinct()
    shards = [np.array(r.fps) for r in simhash.shards(prints).collect()]
    found, plain = set(), simhash.Tree.search

    def counted(tree, wanted, radius):
        k, node = plain(tree, wanted, radius)
        found.update((int(a), int(b)) for a, b in zip(wanted[k], tree.values[node]) if a != b)
        return k, node

    monkeypatch.setattr(simhash.Tree, "search", counted)
    links = [pair for fps in shards for pair in zip(*simhash.shard_links(fps))]
    values = np.unique(np.concatenate(shards)).view(np.uint64)
    near = {(int(v), int(w)) for i in range(0, len(values), 500) for a, b in zip(*np.nonzero(np.bitwise_count(values[i : i + 500, None] ^ values) <= 2)) for v, w in [(values[i + a], values[b])] if v != w}
    assert found == near and len(links) > 5 and np.mean([len(fps) for fps in shards]) > 200


def test_one_of_each_class_stays(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "2", "5", "7", "8", "9", "None", "None"]


# --- op3 ------------------------------------------------------------------------


def test_items_stay_in_order_with_their_captions():
    html = ('<h1>Top</h1><p>One <b>two</b></p><figure><img src="sha256:AB"><figcaption>cap &amp; more</figcaption></figure>'
            '<script>no()</script>tail<img src="x.png" alt="alt">end')
    assert media.parse_items(html) == [
        (0, "text", "Top", None, None), (1, "text", "One two", None, None), (2, "media", None, "ab", "cap & more"),
        (3, "text", "tail", None, None), (4, "media", None, None, "alt"), (5, "text", "end", None, None)]
    assert media.parse_items(None) == []


def slow_media(text):
    """The contract's values, and the figures' places, of one text by plain Python."""
    raw = (text or "").encode()
    payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    images = [media.encode_png(payload[i : i + media.PIECE]) for i in range(0, len(payload), media.PIECE)]
    form, bins = b"".join(images), [0] * 256
    for b in payload:
        bins[b] += 1
    counts = ",".join(str(sum(bins[i : i + 16])) for i in range(0, 256, 16))
    look = f"576x{len(payload) // 576};{sum(payload)};{sum(b * b for b in payload)};{counts}"
    lines, n, places, items = (text or "").split("\n"), len(images), [], 0
    for k in range(n):
        items += sum(bool(x.split()) for x in lines[k * len(lines) // n : (k + 1) * len(lines) // n])
        places.append(items)
        items += 1
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form),
            hashlib.sha256(form).hexdigest(), look, ",".join(map(str, places)), items, f"grey samples, part {n} of {n}")


def test_png_holds_samples():
    from io import BytesIO

    rng = np.random.default_rng(1)
    for n in (576, 1152, media.PIECE):
        samples = rng.integers(0, 256, n, np.uint8).tobytes()
        assert media.read_png(media.encode_png(samples)) == (576, n // 576, samples)
    image = pytest.importorskip("PIL.Image", reason="no other PNG reader here").open(BytesIO(media.encode_png(samples)))
    assert image.tobytes() == samples


def test_stored_media_against_plain_python(spark, odd):
    more = table(spark, SF, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    docs = odd.where("doc_id IS NOT NULL").select("doc_id", "text").unionByName(more)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = media.query(docs).collect()
    for r in rows:
        names = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature media_positions n_items caption".split()
        assert tuple(r[c] for c in names) == slow_media(texts[r.doc_id]), r.doc_id
    several = [r for r in rows if "," in r.media_positions]
    # Interleaved: figures stand between stretches of text.
    assert len(several) > 20 and any(int(r.media_positions.split(",")[0]) < r.n_items - 2 for r in several)


def test_a_digest_that_is_not_stored_and_order_of_items(spark):
    a, b = b"a" * 576, b"b" * 576
    digest = lambda x: hashlib.sha256(x).digest()
    folder = fresh_dir(spark, "test-media")
    places = media.store(spark.createDataFrame([([a, b],), ([b, a],)], "pieces array<binary>"), folder)
    assert sorted(bytes(r.digest) for r in places.collect()) == sorted([digest(a), digest(b)])
    refs = [("x", 0, digest(b)), ("x", 3, digest(a)), ("y", 1, digest(a)), ("y", 2, b"0"), ("z", 5, None)]
    located = media.locate(spark.createDataFrame(refs, "key string, pos int, digest binary"), places)
    assert located.where("file IS NULL").count() == 2
    got = {r.key: r for r in media.assemble(located, ["key"], folder, 3).collect()}
    assert got["x"].payload_sha256 == hashlib.sha256(b + a).hexdigest() and got["x"].media_positions == "0,3"
    assert got["y"].payload_sha256 is None and got["z"].payload_bytes is None


# --- op4 ------------------------------------------------------------------------


def test_measures_against_plain_python(spark, odd):
    for r in quality.measure(odd.select("text")).collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows: dict = {}
        for i in range(len(words) - 2):
            windows.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines))


def test_clean_prose_is_kept_and_junk_goes(spark):
    rng = random.Random(9)
    clean = " ".join(f"{w}{i}" if w not in quality.STOP_WORDS else w for i, w in enumerate(rng.choices(WORDS, k=90)))
    docs = spark.createDataFrame([(1, clean), (2, "### *** " * 60), (3, "short text"), (4, "same line here now\n" * 40)], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [1]


def test_bar_separated_text_goes_and_prose_stays(spark):
    rng = random.Random(13)
    items = [f"{w}{i}" if i % 3 else w for i, w in enumerate(rng.choices(WORDS, k=120))]
    prose_with_some = " ".join(f"{w} costs {i}%" if i % 15 == 0 else w for i, w in enumerate(items))
    docs = spark.createDataFrame([(1, " | ".join(items)), (2, prose_with_some)], "doc_id long, text string")
    assert {r.doc_id: (r.kept, r.failed_rules) for r in quality.query(docs).collect()} == {1: (False, "symbols_per_word"), 2: (True, "")}


# --- op5 ------------------------------------------------------------------------


def slow_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_patterns_against_the_plain_ones():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.", "@", ".", "-", "1", "23", "4111 1111 1111 1111", "+1 (487) 555-7209", " ", "10.0.0.", "é", "x@y.z", "255"]) for _ in range(14))
        assert pii.base_spans(text) == slow_base(text), text
    assert pii.base_spans("9" * 50_000 + "." + "@" * 1000) == slow_base("9" * 50_000)


def test_names_numbers_and_clean_text():
    field = pii.train()
    text = "Please write to Mr. Adam Smith, or Dr Jane Doe.\nMy name is Olga Petrov. SSN 999-12-3456"
    assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, field)] == [
        ("name", "Adam Smith"), ("name", "Jane Doe"), ("name", "Olga Petrov"), ("id", "999-12-3456")]
    assert pii.mask("mail a@b.co or +1 (487) 555-7209 now", pii.base_spans("mail a@b.co or +1 (487) 555-7209 now")) == "mail [EMAIL] or [PHONE] now"
    for clean in ("The house by the river was sold. Nobody In Town knew why.", "The Old Mill Was The Last. No No No No one"):
        assert pii.all_spans(clean, field) == []


#: Prose that the labelled table doesn't hold.
PROSE = """
The first railway in the county ran from Bristol to Bath and was finished in 1840.
When the Great Fire reached the Tower, the King ordered houses to be blown up.
She studied at the University of Edinburgh before the War and later taught in Cairo.
Every Tuesday the Farmers Market sells bread, cheese and Apples from Kent.
The Treaty of Versailles was signed in the Hall of Mirrors in June 1919.
Mount Everest was named after a surveyor; in Nepal it is called Sagarmatha.
Please sign the form and return it to the Registry Office by Friday.
To contact Customer Service, press Star and then the Pound key.
Item 4711 weighs 12.5 kg and costs 99 dollars; order code 12-99-481.
The Bank of England raised its rate, and Wall Street fell by Two percent.
Yours sincerely, The Management. All visitors must report to Reception.
In the name of the Law, open the door! Nobody answered the Officer.
Part Two: How The West Was Won And Where It Got Us.
Der Zug nach München fährt um acht Uhr von Gleis Sieben ab.
Die Freie Hansestadt Bremen hat einen Hafen und viele alte Häuser.
Im Namen des Volkes verkündet das Gericht folgendes Urteil.
Das Deutsche Museum zeigt Schiffe, Flugzeuge und alte Uhren.
Nach dem Abendessen gingen die Kinder mit dem Hund in den Garten.
Die Firma liefert Maschinen und Werkzeuge nach Frankreich und Polen.
La Tour Eiffel a été construite pour l'Exposition Universelle de 1889.
Au nom de la loi, le Maire de Bordeaux a fermé le Pont Neuf.
Les enfants jouent dans le jardin pendant que le chat dort au soleil.
Le Conseil Municipal se réunit chaque Lundi à la Mairie.
Il pleut souvent en Bretagne, mais la mer y est très belle.
La Universidad de Salamanca es una de las más antiguas de Europa.
El tren de Madrid a Sevilla sale de la Puerta de Atocha.
En el nombre de la paz, los Reyes firmaron el Tratado de Tordesillas.
Los niños comen pan con chocolate en la Plaza del Pueblo.
El Museo del Prado abre todos los días menos el Lunes.
La casa tiene dos ventanas, una puerta azul y un balcón.
""".strip().splitlines()


def test_held_out_prose_is_left_alone_and_held_out_names_are_found():
    field = pii.train()
    assert not set(PROSE) & set(pii.table())
    hit = [x for x in PROSE if pii.all_spans(x, field)]
    assert len(hit) <= 1, [(x, pii.all_spans(x, field)) for x in hit]
    # English prose of the standard library's manual, paragraph by paragraph.
    from pydoc_data.topics import topics

    paragraphs = [x for t in topics.values() for x in t.split("\n\n") if len(x.split()) >= 5]
    marked = [x for x in paragraphs if pii.field_spans(x, field)]
    assert len(paragraphs) > 2000 and len(marked) <= 0.02 * len(paragraphs)
    frames = ("Please contact [N] about it.", "My name is [N] and I am here.", "Dr. [N] left.", "Dear Ms. [N], thank you.", "Sincerely, [N]", "The form was signed by [N] today.")
    names = ("Yusuf Aydin", "Grace Okafor", "Wei Zhang", "Priya Nair", "Tomasz Kowalski", "Aiko Mori")
    found = sum(("name", name) in [(k, t[a:b]) for k, a, b in pii.all_spans(t, field)] for name in names for frame in frames for t in [frame.replace("[N]", name)])
    assert found >= 0.9 * len(names) * len(frames)


def test_decoder_and_screen_against_every_path():
    from itertools import product

    field = pii.train()
    for marked in pii.table()[:60]:
        words, labels = pii.read_labelled(marked)
        scores = field.emissions([words])
        assert list(field.decode([scores])[0]) == labels
        short = scores[:6]

        def total(path):
            return sum(short[t, y] for t, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:])) + (pii.NEVER if path[0] == pii.INSIDE else 0)

        best = max(product(range(pii.LABELS), repeat=len(short)), key=total)
        assert tuple(field.decode([short])[0]) == best
        if any(best):
            assert len(field.can_hold(short, np.array([len(short)])))


def test_screen_keeps_lines_that_open_with_a_span():
    trained, rng = pii.train(), random.Random(31)
    cold = trained.moves.copy()
    cold[:, [pii.BEGIN, pii.NUMBER]] -= 12.0
    names = [n for n in " ".join(pii.NAMES).split()] + ["John", "Maria", "536-22-1984"]
    rest = "the house was sold . and Contact Dr. name of Regards, today".split()
    lines = [[rng.choice(names) for _ in range(rng.randint(1, 3))] + [rng.choice(rest) for _ in range(rng.randint(0, 5))] for _ in range(2000)]
    for field in (trained, pii.Field(trained.weights, cold)):
        scores = field.emissions(lines)
        ends = np.cumsum([len(x) for x in lines])
        # Around the point at which the first word's gain decides.
        for nudge in (0.0, 1.0, 2.0, 4.0):
            raised = scores.copy()
            raised[ends - [len(x) for x in lines], 1:] += nudge
            held = set(field.can_hold(raised, ends).tolist())
            marked = {i for i, best in enumerate(field.decode(np.split(raised, ends[:-1]))) if best.any()}
            assert marked <= held


def test_counts_and_digest_against_the_plain_patterns(spark, odd):
    field = pii.train()
    docs = odd.select("doc_id", "text").unionByName(table(spark, SF, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in pii.query(docs.where("doc_id IS NOT NULL")).collect():
        base = slow_base(texts[r.doc_id])
        spans = base + pii.field_spans(texts[r.doc_id], field)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.spans.startswith(said) and set(filter(None, r.spans.split(","))) <= {f"{k}:{a}:{b}" for k, a, b in spans}


# --- op6 ------------------------------------------------------------------------


def test_rollups_follow_changes_and_repeat_nothing(spark):
    store = rollups.Rollup(spark, fresh_dir(spark, "test-rollup"))
    change = lambda rows: spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, version string, n_tokens long")
    first = change([("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", None, "v1", 5), ("insert", 2, "a", None, "v2", 7), ("insert", None, "b", "en", "v1", 3)])
    assert store.commit("one", first) and not store.commit("one", first)
    assert store.commit("two", change([("revise", 1, "a", "en", "v1", 12), ("delete", 2, None, None, None, None), ("delete", 99, None, None, "v1", None)]))
    assert store.commit("three", change([("insert", 3, "c", "en", "v1", 1)]))
    totals = lambda: sorted((r.source, str(r.lang), r.version, r.docs, r.tokens) for r in store.totals().collect())
    want = [("a", "en", "v1", 1, 12), ("b", "en", "v1", 1, 3), ("c", "en", "v1", 1, 1)]
    assert totals() == want and store.committed() == ["one", "two", "three"]
    # A batch cut short before its commit file leaves the totals as they were.
    change([("insert", 4, "d", "en", "v1", 9)]).select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), F.lit(32).alias("of"), F.lit(0).alias("part")).write.partitionBy("of", "part").parquet(f"{store.path}/ledger/four")
    assert totals() == want
    assert store.commit("four", change([("insert", 4, "d", "en", "v1", 9)])) and ("d", "en", "v1", 1, 9) in totals()


def test_small_batches_read_their_buckets_and_folds_change_nothing(spark):
    rng = random.Random(3)
    store = rollups.Rollup(spark, fresh_dir(spark, "test-rollup"), parts=8, fold_after=4)
    schema = "op string, doc_id long, source string, lang string, version string, n_tokens long"
    held: dict = {}
    for n in range(7):
        rows, ids = [], rng.sample(range(40), 12)
        for i in ids:
            op = rng.choice(["insert", "revise", "delete"])
            if op != "insert":
                held.pop(i, None)
            if op != "delete":
                rows.append((op, i, rng.choice("ab"), None, "v", rng.randint(0, 9)))
                held.setdefault(i, []).append(rows[-1][2:])
            else:
                rows.append((op, i, None, None, None, None))
        rows.append(("insert", None, "a", "en", "v", 1))
        held.setdefault(None, []).append(("a", "en", "v", 1))
        assert store.commit(f"b{n}", spark.createDataFrame(rows, schema))
        want: dict = {}
        for source, lang, version, tokens in (x for xs in held.values() for x in xs):
            k = (source, lang, version)
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + tokens)
        assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in store.totals().collect()} == want
    assert [b for b in store.committed() if b.startswith("fold-")] and len(store._live()) < 7
    with pytest.raises(ValueError):
        store.commit("fold-x", spark.createDataFrame([], schema))
    one = store._signed(spark.createDataFrame([("delete", 5, None, None, None, None)], schema))
    assert "part" in one._jdf.queryExecution().executedPlan().toString()  # a partition filter on the ledger's files


def test_buckets_follow_the_size_and_folds_reclaim(spark, monkeypatch):
    monkeypatch.setattr(rollups, "ROWS", 50)
    store = rollups.Rollup(spark, fresh_dir(spark, "test-rollup"), parts=2, fold_after=2)
    rows = spark.range(400).select(
        F.lit("insert").alias("op"), F.when(F.col("id") < 100, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.lit("v").alias("version"), F.lit(1).cast("long").alias("n_tokens"))
    assert [store.width(n) for n in (0, 100, 101, 800)] == [2, 2, 4, 16]
    store.commit("load", rows)
    # Rows without an id and of one group are spread over the buckets.
    parts = [r["n"] for r in store.ledger().where("doc_id IS NULL").groupBy("of", "part").agg(F.count("*").alias("n")).collect()]
    assert store._widths() == [16] and len(parts) == 16 and max(parts) < 60
    few = rows.where("doc_id < 3").withColumn("n_tokens", F.lit(5).cast("long")).withColumn("op", F.lit("revise"))
    for n in range(6):
        store.commit(f"b{n}", few)
        assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(400, 412)]
    assert store._widths()[-1] == 4
    names = store.committed()
    last = [b for b in names if b.startswith("fold-")]
    gone = names[: names.index(last[-2])]
    there = lambda b: store._fs(f"ledger/{b}")[0].exists(store._fs(f"ledger/{b}")[1])
    assert len(last) > 1 and not any(map(there, gone)) and all(map(there, names[names.index(last[-2]) :]))


def test_rollups_of_odd_rows(spark, odd):
    import base64

    import tiktoken

    pairs = (x.split() for x in open(rollups.RANKS, "rb"))
    enc = tiktoken.Encoding("t", pat_str=rollups.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    rows = odd.select("doc_id", "text", "lang", "source").collect()
    least: dict = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    want: dict = {}
    for r in rows:
        text = r.text or ""
        if r.doc_id is not None and r.doc_id not in {least[x.text or ""] for x in rows if x.doc_id is not None}:
            continue
        exact = [len(enc.encode_ordinary(text))]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        for version, counts in (("byte_bpe_50k", exact), ("words", [words])):
            k = (r.source, r.lang, version)
            want[k] = (want.get(k, (0, 0))[0] + len(counts), want.get(k, (0, 0))[1] + sum(counts))
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollups.query(odd).collect()} == want


def test_rollup_query_against_recounting(spark):
    import base64

    import tiktoken

    docs = table(spark, SF, "documents")
    pairs = (x.split() for x in open(rollups.RANKS, "rb"))
    enc = tiktoken.Encoding("t", pat_str=rollups.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        if r.text in seen:
            continue
        seen.add(r.text)
        for version, n in (("byte_bpe_50k", len(enc.encode_ordinary(r.text))), ("words", len(r.text.split()))):
            k = (r.source, r.lang, version)
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollups.query(docs).collect()}
    assert got == want


# --- op7 ------------------------------------------------------------------------


#: The tests' own terms.
INSULTS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = [*INSULTS, "abc", "abcdefghij"]
    lexicon, rng = toxicity.Lexicon(terms), random.Random(1)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = [rng.choice("abcdeorstu")] * rng.randint(0, 1)
        word = "".join(word)
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t)]
        assert lexicon.match(word) == (min(near)[::-1] if near else None)


def test_quotation_scores_below_abuse():
    reader = toxicity.Reader(dict.fromkeys(INSULTS, 4.0))
    aimed, cited = reader.features("you are a stupid id1ot"), reader.features('he wrote the word "idiot" here')
    assert aimed[0] > 0 and aimed[2] > 0 and cited[0] == 0 and cited[1] > 0
    assert reader.features(None) == reader.features("") == [0.0] * 4


def test_rare_and_short_terms_are_learned(spark):
    rng = random.Random(21)
    terms = sorted({"".join(rng.choice("bcdfgkmpqvxz") for _ in range(3 + i % 5)) for i in range(80)})
    # Each term stands in 10 of the labelled documents, about 1.3 % of the toxic ones.
    made = [(prose(rng, 30) + f" {t} " + prose(rng, 30), 1) for t in terms for _ in range(10)]
    made += [(prose(rng, 60), 0) for _ in range(3200)]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic) for i, (_, toxic) in enumerate(made)], "doc_id long, toxic int")
    every = toxicity.learnable(docs, labels)
    counts = toxicity.count_words(every)
    assert set(toxicity.learn_terms(every, counts)) == set(terms)
    assert len(toxicity.learn_terms(every, counts, most=7)) == 7
    shuffled = toxicity.learnable(docs, labels, broadcast=10)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, every.collect()))
    rows = toxicity.query(docs, labels).collect()
    assert all(r.predicted == made[r.doc_id][1] for r in rows)


def test_four_letters_allow_an_edit_and_one_sighting_drops_nothing(spark):
    assert toxicity.Lexicon(["scum"]).match("scvm") == ("scum", 1)
    made = [("scvm idiott", 0), *[("the moran", 0)] * 3]
    rows = spark.createDataFrame([(toxicity.tokens(t), b) for t, b in made], "words array<string>, toxic int")
    rigid, ordinary = toxicity.common_misspellings(toxicity.count_words(rows), dict.fromkeys(INSULTS, 4.0), INSULTS)
    assert rigid == [] and ordinary == ["moran"]


def test_one_tokeniser_learns_and_matches(spark):
    assert toxicity.tokens("'Idiot', he said: don’t “fool'") == ["idiot", "he", "said", "don’t", "“", "fool"]
    rng = random.Random(23)
    docs = spark.createDataFrame([(i, prose(rng, 20) + (" 'zwonk' " if i % 2 else " ") + prose(rng, 20)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    every = toxicity.learnable(docs, labels)
    assert set(toxicity.learn_terms(every, toxicity.count_words(every))) == {"zwonk"}


def test_copies_are_one_piece_of_evidence_and_terms_can_be_given(spark):
    rng = random.Random(31)
    made = [("copied zwonk " + "of one text " * 5, 1)] * 40 + [(prose(rng, 40) + " grelk", 1) for _ in range(40)] + [(prose(rng, 40), 0) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(made)], "doc_id long, toxic int")
    every = toxicity.learnable(docs, labels)
    assert set(toxicity.learn_terms(every, toxicity.count_words(every))) == {"grelk"}
    none = labels.where("false")
    rows = toxicity.query(docs, none).collect()
    assert len({r.score for r in rows}) == 1
    given = toxicity.score(docs, toxicity.learn(docs, none, {"zwonk": 4.0})).collect()
    assert {r.score > 0.5 for r in given if made[r.doc_id][0].startswith("copied")} == {True}
    assert {r.score > 0.5 for r in given if not made[r.doc_id][0].startswith("copied")} == {False}


def slow_features(text, odds, window=toxicity.WINDOW):
    """Features from the definitions: nearest term by edit distance, context by plain loops."""
    words, hits = toxicity.tokens(text), []
    for i, w in enumerate(words):
        near = [(distance(w, t), t) for t in odds if abs(len(w) - len(t)) < 3 and distance(w, t) <= toxicity.edits_allowed(t)]
        if near:
            hits.append((i, min(near)[1], min(near)[0]))
    inside, start = set(), None
    for i, w in enumerate(words):
        if w in ("“", "«", "„", "‹", "”", "»", "›", '"'):
            if start is not None and w in ("”", "»", "“", "›", '"') and i - start <= 60:
                inside.update(range(start + 1, i))
                start = None
            else:
                start = i if w in ("“", "«", "„", "‹", '"') else None
    best, aim, total = {}, 0.0, 0.0
    for i, term, edits in hits:
        near = words[max(0, i - window) : i + window + 1]
        quoted = i in inside or bool(set(near) & toxicity.REPORTING)
        aimed = bool(set(near) & toxicity.ADDRESS) or any(j != i and abs(j - i) <= window for j, _, _ in hits)
        weight = toxicity.EDIT_WEIGHT[edits]
        best[(quoted, term)] = max(best.get((quoted, term), 0.0), weight * odds[term])
        aim += weight * (aimed and not quoted)
        total += weight * (0.3 if quoted else 1.0)
    sums = [sum(v for (q, _), v in best.items() if q == which) for which in (False, True)]
    return [*sums, np.log1p(aim), np.log1p(100 * total / len(words))] if hits else [0.0] * 4


def test_features_against_plain_loops():
    rng = random.Random(17)
    odds = {"idiot": 4.0, "scum": 3.5, "worthless": 5.0, "abc": 2.0}
    pool = [*WORDS, "idiot", "idiott", "scvm", "scum", "worthles", "abc", "abd", "you", "said", '"', "“", "”", "don't"]
    reader = toxicity.Reader(odds)
    for _ in range(400):
        text = " ".join(rng.choices(pool, k=rng.randint(1, 40)))
        assert np.allclose(reader.features(text), slow_features(text, odds)), text


def test_held_out_scores_separate(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    wins = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good)
    assert wins > 0.93 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


# --- op8 ------------------------------------------------------------------------


def test_targets_against_resharing(spark):
    rng = random.Random(12)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 5, 77]) for i in range(9)} | {None: 13}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        want, left = dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
        for _ in range(5000):
            free = [s for s in sizes if want[s] < 3 * sizes[s]]
            if left < 1e-9 or not free:
                break
            share = left / sum(weights[s] for s in free)
            left = 0.0
            for s in free:
                want[s] += share * weights[s]
                left += max(0.0, want[s] - 3 * sizes[s])
                want[s] = min(want[s], 3.0 * sizes[s])
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix_meets_targets_in_curriculum_order(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.query(docs).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
        assert all(r.taken <= 3 * r.size for r in own)
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, name):
    import duckdb

    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for source in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{sf}/{source}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    sql = con.sql(queries.ORACLE_SQL[name])
    assert sorted(sql.columns) == sorted(found.columns)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_every_pass_follows_its_schedule_to_the_end(spark):
    # 20 equal sources: weight 3 is passed over about one and a half times.
    # One hot source beside small ones: those are at the cap of three passes.
    equal = {f"s{i:02d}": 40 for i in range(20)}
    hot = {"a": 10, "b": 10, "c": 10, "hot": 3000}
    for sizes in (equal, hot):
        made = [(i, "one two three four five", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
        docs = spark.createDataFrame(made, "doc_id long, text string, source string")
        plan = {r.source: r for r in mixing.source_targets(spark.createDataFrame([(s, 5 * n) for s, n in sizes.items()], "source string, source_size long")).collect()}
        order = [r.source for r in mixing.mixed(docs).collect()]
        assert max(r.target / r.source_size for r in plan.values()) > 1.5
        for t in (0.25, 0.5, 0.75, 0.9, 1.0):
            head = order[: round(sum(r.whole * (r.a * t + (r.b - r.a) / 2 * t * t) for r in plan.values()) / 5)]
            for s, r in plan.items():
                assert abs(5 * head.count(s) - r.whole * (r.a * t + (r.b - r.a) / 2 * t * t)) <= 10, (s, t)


def test_copies_of_a_document_lie_apart_and_ties_are_decided(spark):
    docs = table(spark, SF.replace("0.001", "0.1"), "documents").select("doc_id", "text", "source")
    plan = mixing.mix(docs).where("size(positions) > 1").collect()
    whole = sum({r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}.values())
    for r in plan:
        gaps = [b - a for a, b in zip(r.positions, r.positions[1:])]
        assert r.positions[0] == r.position and min(gaps) > 0.1 * whole, r
    # Each source's words in each tenth of the stream are those its schedule asks for.
    targets = {r.source: r for r in mixing.source_targets(mixing.mix(docs).groupBy("source").agg(F.first("source_size").alias("source_size"))).collect()}
    end = sum(r.whole for r in targets.values())
    at = lambda t: sum(r.whole * (r.a * t + (r.b - r.a) / 2 * t * t) for r in targets.values())
    got: dict = {}
    for r in mixing.mix(docs).where("copies > 0").collect():
        for p in r.positions:
            got[(r.source, p)] = got.get((r.source, p), 0) + r.size
    for k in range(10):
        lo, hi = at(k / 10), at((k + 1) / 10)
        assert abs(sum(n for (_, p), n in got.items() if lo <= p < hi) - (hi - lo)) < 0.02 * end
    # Equal ids and sizes, other texts: the order is that of the texts' digests, however rows are dealt.
    tied = spark.createDataFrame([(i // 8, f"w{i} x{i} y{i}", "ab"[i % 2]) for i in range(64)], "doc_id long, text string, source string")
    first = mixing.mixed(tied).collect()
    assert first == mixing.mixed(tied.repartition(5, "text")).collect() == mixing.mixed(tied.orderBy(F.desc("text"))).collect()


@pytest.mark.parametrize("keep", [False, True])
def test_rows_of_one_id_and_text_are_dealt_out(spark, monkeypatch, keep):
    """Rows without an id, and many of one text: the mix is that of one window, whatever is dealt out."""
    rows = [(None, "one two three", "a", n % 3) for n in range(700)] + [(None, f"w{n} x", "a", 0) for n in range(300)] + [(7, "seven", "b", 0)] * 400
    rows += [(n, "some words here " * (n % 4), "bc"[n % 2], 0) for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(9)
    shown = lambda plan: sorted(str([r[c] for c in ("doc_id", "source", "size", "taken", "copies", "position", "positions")]) for r in plan.collect())
    want = shown(mixing.mix(docs, keep_rows=keep))
    monkeypatch.setattr(mixing, "HOT", 100)
    monkeypatch.setattr(mixing, "SALTS", 8)
    assert shown(mixing.mix(docs, keep_rows=keep)) == want
    # No window of the whole key: its rows come to each task in parts.
    plan = mixing.mix(docs, keep_rows=keep)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_many_rows_without_an_id_are_spread_over_buckets(spark):
    assert [mixing.bucket_digits(n) for n in (0, 10**6, 10**9, 10**10, 3 * 10**11)] == [3, 3, 3, 4, 6]
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    key = F.md5(F.concat(F.lit(":"), F.md5("text")))
    most = docs.groupBy(F.substring(key, 1, 3).alias("b")).count().agg(F.max("count")).head()[0]
    assert most < 70
    assert mixing.mix(docs).agg(F.sum("taken")).head()[0] == 200_000


def test_due_inverts_the_integral(spark):
    for a, b in mixing.SCHEDULES.values():
        for t in (0.0, 0.25, 0.9, 1.0):
            share = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            got = spark.range(1).select(mixing.due(F.lit(share), F.lit(a), F.lit(b)).alias("t")).head().t
            assert abs(got - t) < 1e-9


# --- op9 ------------------------------------------------------------------------


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9):
        code = langid.codewords(n)
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert far >= (1 if n < 3 else 2)
    assert len({tuple(c) for c in langid.codewords(5).T}) == 15


def slow_counts(text):
    """Buckets of every n-gram of the folded text between two blanks, one by one."""
    folded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out: dict = {}
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            key = 0
            for c, prime in zip(folded[i : i + n], langid._PRIMES):
                key = (key * int(prime) + ord(c)) % 2**32
            bucket = (key * 0x9E3779B1 % 2**32) >> (33 - langid.BUCKETS.bit_length())
            out[bucket] = out.get(bucket, 0) + 1
    return out, sum(c != " " for c in folded)


def slow_prediction(model, text):
    """Features, margins, losses and the nearest codeword by plain sums."""
    counts, letters = slow_counts(text or "")
    if not letters:
        return "und", 0.0
    total = sum(counts.values())
    x = {b: float(np.rint(np.sqrt(n / total).astype(np.float32) * np.float32(langid.FEATURE_UNIT))) for b, n in counts.items()}
    unit = langid.FEATURE_UNIT * langid.WEIGHT_UNIT
    margins = [sum(v * model.weights[b, k] for b, v in x.items()) / unit + float(model.bias[k]) for k in range(model.code.shape[1])]
    losses = [sum(float(np.logaddexp(0.0, -m * s)) for m, s in zip(margins, word)) for word in model.code]
    best = min(range(len(losses)), key=losses.__getitem__)
    return model.langs[best], 1 / sum(np.exp(losses[best] - v) for v in losses)


def test_long_texts_are_counted_whole():
    counter, rng = langid.Counter(), random.Random(2)
    text = prose(rng, 1000) + "İß漢"
    whole, letters = counter.counts([text])
    assert {b: int(whole[0, b]) for b in np.flatnonzero(whole[0])} == slow_counts(text)[0] and letters[0] == slow_counts(text)[1]
    for step in (1, 2, 3, 7, 700, len(text), len(text) + 1):
        part, n = counter.long_counts(text, step)
        assert (part == whole).all() and n[0] == letters[0]


def test_counts_and_scores_stand_alone(spark):
    counter, rng = langid.Counter(), random.Random(5)
    texts = ["ab", "xyz", "ab", "qrs", "", "12", "la", "la", *(prose(rng, rng.randint(1, 30)) for _ in range(40))]
    for order in (texts, texts[::-1], rng.sample(texts, len(texts))):
        counts, letters = counter.counts(order)
        for t, row, n in zip(order, counts, letters):
            assert ({b: int(row[b]) for b in np.flatnonzero(row)}, n) == slow_counts(t)
    docs = table(spark, SF, "documents")
    docs = docs.unionByName(docs.where("n_chars < 400"))  # repeated rows
    model = langid.learn(docs)
    scored = lambda d: sorted((r.doc_id, r.found.lang_pred, r.found.score, r.found.ambiguous) for r in langid.identify(d.select("doc_id", "text"), model).collect())
    first = scored(docs)
    assert first == scored(docs.repartition(7)) == scored(docs.orderBy("n_chars").coalesce(1))
    assert len({r[0] for r in first}) == len(set(first))
    plain = {r.doc_id: slow_prediction(model, r.text) for r in docs.select("doc_id", "text").collect()}
    for doc_id, lang, score, _ in first:
        assert plain[doc_id][0] == lang and abs(plain[doc_id][1] - score) < 1e-9


def test_rare_languages_are_drawn(spark):
    rows = [(i, "the house", "en") for i in range(3000)] + [(i, "la casa", "it") for i in range(3000, 3004)]
    drawn = langid.sample_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100).collect()
    assert sum(r.lang == "en" for r in drawn) == 50 and 0 < sum(r.lang == "it" for r in drawn) <= 4


def test_held_out_languages(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    rows = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.9
    odd_rows = langid.query(spark.createDataFrame([(1, None, "en"), (2, "12 34 ..", "en"), (4, "the and", "en"), (5, "und der", "de")], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in odd_rows.collect() if r.doc_id < 3} == {1: "und", 2: "und"}


# --- op10 -----------------------------------------------------------------------


def test_packages_are_plain_zip_files_and_read_by_ranges(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/\nb", big), (2, None, big), (3, "u", "tiny"), (4, "u", "tiny"), (None, "u", big), (5, "v", None)], "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in warc.query(pages).collect()}
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got == {
        1: (1500, sha(big), "revisit", 2), 2: (1500, sha(big), "response", None), None: (1500, sha(big), "revisit", 2),
        3: (4, sha("tiny"), "response", None), 4: (4, sha("tiny"), "response", None), 5: (0, sha(""), "response", None)}


def slow_records(rows):
    """The contract's row of each page, by plain Python."""
    groups: dict = {}
    for page_id, html in rows:
        raw = (html or "").encode()
        groups.setdefault(raw, []).append(page_id)
    out = []
    for raw, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = max(known) if known and len(ids) > 1 and len(raw) >= 1000 else None
        for i in ids:
            own = first is None or i == first
            out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if own else "revisit", None if own else first))
    return sorted(out, key=str)


def test_ids_of_64_bits_beside_nulls(spark):
    big, other = "x" * 1500, "y" * 1200
    ids = [2**53 + 1, 2**53 - 4, None, 2**63 - 1, 2**63 - 2, -(2**63), 2**62 + 1]
    rows = [(i, [big, big, big, other, other, other, "z"][k]) for k, i in enumerate(ids)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").coalesce(1)
    assert sorted(map(tuple, warc.query(pages).collect()), key=str) == slow_records(rows)


def test_one_id_with_several_payloads(spark):
    """A revisit gets the size and digest of the payload that it repeats, whatever else its response's id stands for."""
    a, b, c = "A" * 1500, "B" * 2500, "C" * 1500
    rows = [(7, a), (7, b), (3, a), (4, b), (7, c), (7, c), (5, c), (None, b), (7, "short"), (2, "short")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    got = sorted(map(tuple, warc.query(pages).collect()), key=str)
    assert got == slow_records(rows)
    assert {g[0]: g[1] for g in got if g[3] == "revisit"} == {3: 1500, 4: 2500, 5: 1500, None: 2500}


def test_whole_page_table_against_plain_python(spark):
    pages = table(spark, SF.replace("0.001", "0.01"), "pages")
    rows = [(r.page_id, r.html) for r in pages.select("page_id", "html").collect()]
    assert sorted(map(tuple, warc.query(pages).collect()), key=str) == slow_records(rows)


def test_zip64_directory():
    """A package whose sizes and offsets are only in ZIP64 fields."""
    import struct

    data = gzip.compress(warc.record(7, "u", b"body", "d", None), mtime=0)
    name = warc.DATA.encode()
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(data)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + data + central + end + locator + tail
    assert zipfile.ZipFile(io.BytesIO(whole)).read(warc.DATA) == data
    package = warc.Package(lambda a, n: whole[a : a + n], len(whole))
    assert package.stored(warc.DATA) == (len(local), len(data))
    headers, payload = next(warc.read_records(package, [{"offset": 0, "length": len(data)}]))
    assert headers["warc-record-id"] == "<urn:page:7>" and payload == b"body"


def test_field_spans_that_touch_a_pattern_go(monkeypatch):
    rng = np.random.default_rng(9)
    for _ in range(300):
        draw = lambda kind, n: [(kind, int(a), int(a + d)) for a, d in zip(rng.integers(0, 40, n), rng.integers(1, 9, n))]
        base, found = draw("email", rng.integers(0, 5)), draw("name", rng.integers(0, 6))
        monkeypatch.setattr(pii, "base_spans", lambda text: base)
        monkeypatch.setattr(pii, "field_spans", lambda text, field: found)
        assert pii.all_spans("x", None) == base + [s for s in found if not any(s[1] < b and a < s[2] for _, a, b in base)]
