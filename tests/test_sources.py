"""Files, streams and the public face."""

import json
import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.codemap import CodeMap
from graphloom.functions import text
from graphloom.operators import layout, overlay
from graphloom.operators import annotate
from graphloom.sources import git, mapfile, published
from graphloom.streaming.changes import stream_overlays
from test_operators import file, fn, make_edges, make_nodes


def sample(spark):
    nodes = make_nodes(spark, [file("app.ts"), file("lib/util.ts"), fn("app.ts", "main"), fn("lib/util.ts", "help")])
    edges = make_edges(spark, [
        ("file:app.ts", "file:lib/util.ts", "imports"), ("file:app.ts", "function:app.ts:main", "contains"),
        ("function:app.ts:main", "function:lib/util.ts:help", "calls")])
    return CodeMap(nodes, edges)


def test_published_map_answers_alike(spark, tmp_path):
    made = sample(spark)
    read = made.publish(f"file://{tmp_path}/map")
    assert read.tour().collect() == made.tour().collect()
    assert {r.name for r in read.flows.collect()} == {"main → help"}
    read.register_views()
    assert spark.sql("SELECT count(*) AS n FROM edges WHERE kind = 'imports'").head().n == 1
    assert [r.node_id for r in read.context("util help").orderBy("rank").limit(1).collect()] == ["function:lib/util.ts:help"]  # 3 for its name, 2 for its path


def test_map_file_round_trip_and_old_versions(spark, tmp_path):
    made = sample(spark)
    at = f"{tmp_path}/map.json"
    mapfile.write_map(made.nodes, made.edges, made.layers, at, "demo")
    assert open(at).read().endswith("}\n")
    tables = mapfile.read_map(spark, at)
    assert tables["nodes"].count() == 4 and mapfile.edges_of(tables).count() == 3 and tables["tour"].count() == 0
    old = {"version": "0.1.0", "project": {"name": "x"}, "nodes": [{"id": "file:a", "kind": "file", "name": "a", "path": "a", "summary": "", "provenance": "structural"}],
           "edges": [{"source": "file:a", "target": "file:gone", "kind": "imports", "weight": 0.7}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    tables = mapfile.read_map(spark, f"{tmp_path}/old.json")
    assert tables["edges"].count() == 1 and mapfile.edges_of(tables).count() == 0 and tables["layers"].count() == 0


def test_store_of_another_version_is_empty(spark, tmp_path):
    entry = {"annotations": {"file:a": {"content_hash": "h", "summary": "s"}}, "tour": {"file:a": {"inputs_hash": "i", "text": "t"}}}
    for version, n in ((2, 2), (1, 0)):
        (tmp_path / f"s{version}.json").write_text(json.dumps({"version": version} | entry))
        assert mapfile.read_store(spark, f"{tmp_path}/s{version}.json").count() == n
    (tmp_path / "bad.json").write_text("{ no json")
    assert mapfile.read_store(spark, f"{tmp_path}/bad.json").count() == 0
    assert mapfile.read_store(spark, f"{tmp_path}/none.json").count() == 0


def test_git_changes(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b.c", "-c", "user.name=t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("one")
    paths = lambda: sorted(r.path for r in git.changed_paths(spark, str(tmp_path)).collect())
    assert paths() == ["a.txt", "b.txt"]
    run("add", ".")
    run("commit", "-qm", "x")
    assert paths() == []
    (tmp_path / "a.txt").write_text("two")
    run("mv", "b.txt", "c.txt")
    (tmp_path / "new.txt").write_text("n")
    (tmp_path / ".graphloom").mkdir()
    (tmp_path / ".graphloom" / "map.json").write_text("{}")
    assert paths() == ["a.txt", "b.txt", "c.txt", "new.txt"]


def test_stream_of_changes(spark, tmp_path):
    made = sample(spark).publish(f"file://{tmp_path}/map")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path": "lib/util.ts"}\n')
    stream_overlays(spark, f"{tmp_path}/in", f"file://{tmp_path}/map", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = {(r.node_id, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    changed = spark.createDataFrame([("lib/util.ts",)], "path string")
    assert got == {tuple(r) for r in overlay.overlay(made.nodes, made.edges, changed).collect()}


def test_overlay_json(spark):
    marks = spark.createDataFrame([("b", "changed"), ("a", "changed"), ("c", "affected")], "node_id string, status string")
    row = mapfile.overlay_json(marks, spark.createDataFrame([], "path string")).head()
    assert json.loads(row.json) == {"version": 1, "changed": ["a", "b"], "affected": ["c"], "unmapped_paths": []}


def test_schema_ignore_file_and_envelope(spark, tmp_path):
    from pyspark.sql import types as T

    from graphloom.sources import repository

    schema = mapfile.json_schema(T.StructType.fromDDL(mapfile.MAP), {"version": r"^\\d+\\.\\d+\\.\\d+$"})
    assert schema["properties"]["edges"]["items"]["properties"]["weight"] == {"type": "number"}
    assert schema["properties"]["version"]["pattern"].startswith("^")
    assert mapfile.write_ignore_file(str(tmp_path)) and not mapfile.write_ignore_file(str(tmp_path))
    files = spark.createDataFrame([("app.ts", "aé" * 10), ("other.ts", "x")], "path string, text string")
    one = repository.source_envelope(files, sample(spark).nodes, "file:app.ts", 5).collect()
    assert [(r.path, r.language, r.text, r.truncated) for r in one] == [("app.ts", "TypeScript", "aéa", True)]
    assert repository.source_envelope(files, sample(spark).nodes, "file:other.ts").count() == 0


def test_ask_refuses_and_verifies(spark):
    from graphloom.operators import retrieval

    nodes = sample(spark).nodes
    questions = spark.createDataFrame([(1, "help?"), (2, " "), (3, "x" * 1001)], "item_id long, text string")
    said = retrieval.ask(nodes, questions, provider=lambda q, shown: ("yes", [shown[0], "invented", shown[0]]))
    assert [a["status"] for a in said] == ["ok", "the question is empty", "the question is 1001 characters; the limit is 1000"]
    assert said[0]["citations"] == ["function:lib/util.ts:help"]


def test_percent_escapes_are_decoded_one_by_one(spark):
    cases = {"%41%zz": "A%zz", "100%": "100%", "a%2": "a%2", "%%41": "%A", "%E2%82%ACx": "€x", "é%20\n+": "é \n+", "": "", "%ff": "\ufffd"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.percent_decoded(F.col("v")).alias("d")).collect()
    assert {r.v: r.d for r in got} == cases


def test_text_functions(spark):
    row = spark.range(1).select(
        text.slug(F.lit(" my repo/name! ")).alias("a"), text.slug(F.lit("//")).alias("b"), text.percent_decoded(F.lit("a%20b+c")).alias("c"),
        text.percent_decoded(F.lit("100%")).alias("d"), text.escaped(F.lit("<a & 'b'>")).alias("e"),
        text.usage(F.lit('{"usage": {"input_tokens": 3, "output_tokens": 4}}')).alias("f"), text.usage(F.lit('{"usage": {"input_tokens": 3}}')).alias("g")).head()
    assert (row.a, row.b, row.c, row.d, row.e) == ("my-repo-name", "map", "a b+c", "100%", "&lt;a &amp; &#39;b&#39;&gt;")
    assert tuple(row.f) == (3, 4) and row.g is None


def test_back_links_and_grid(spark):
    links = spark.createDataFrame([("v", "a", "b"), ("v", "b", "c"), ("v", "c", "a"), ("v", "c", "d"), ("v", "d", "d")], "view string, source string, target string")
    assert {(r.source, r.target) for r in layout.back_links(links).collect()} == {("c", "a"), ("d", "d")}
    depth = spark.createDataFrame([(f"n{i}", 0 if i < 5 else 3) for i in range(7)], "node_id string, depth int")
    got = {r.node_id: (r.band, r.row, r.column) for r in layout.grid(depth).collect()}
    assert got["n0"] == (0, 0, 0) and got["n4"] == (0, 1, 0) and got["n5"] == (1, 2, 0) and got["n6"] == (1, 2, 1)


def _crossings(band, place, links):
    count = 0
    for i, (a, b) in enumerate(links):
        for c, d in links[i + 1 :]:
            if band[a] == band[c] and band[b] == band[d] == band[a] + 1:
                count += (place[a] - place[c]) * (place[b] - place[d]) < 0
    return count


def test_ordering_takes_crossings_out(spark):
    random = np.random.default_rng(5)
    for _ in range(20):
        band = np.sort(random.integers(0, 4, 24))
        band = np.unique(band, return_inverse=True)[1]
        place = np.concatenate([np.arange(n) for n in np.bincount(band)])
        links = np.array([(a, b) for a, b in random.integers(0, 24, (60, 2)) if band[a] < band[b]]).reshape(-1, 2)
        got = layout.uncrossed(band, place, links)
        for b in set(band):
            assert sorted(got[band == b]) == list(range((band == b).sum()))
        assert _crossings(band, got, links.tolist()) <= _crossings(band, place, links.tolist())
    cards = spark.createDataFrame([("v", "a", 0, 0), ("v", "b", 0, 1), ("v", "c", 1, 0), ("v", "d", 1, 1), ("w", "x", 0, 0)], "view string, node_id string, band int, place int")
    links = spark.createDataFrame([("v", "a", "d"), ("v", "b", "c"), ("u", "a", "b")], "view string, source string, target string")
    placed = layout.ordered(cards, links)
    assert {(r.view, r.node_id, r.band, r.place) for r in placed.collect()} == {("v", "a", 0, 0), ("v", "b", 0, 1), ("v", "d", 1, 0), ("v", "c", 1, 1), ("w", "x", 0, 0)}
    alone = spark.createDataFrame([("v", "k", 0), ("v", "l", 1), ("v", "m", 2), ("z", "q", 0)], "view string, node_id string, place int")
    at = {(r.view, r.node_id): (r.x, r.y) for r in layout.drawing(placed, alone).collect()}
    assert at == {("v", "a"): (109.0, 0.0), ("v", "b"): (327.0, 0.0), ("v", "d"): (109.0, 130.0), ("v", "c"): (327.0, 130.0), ("w", "x"): (0.0, 0.0),
                  ("v", "k"): (0.0, 332.0), ("v", "l"): (218.0, 332.0), ("v", "m"): (436.0, 332.0), ("z", "q"): (0.0, 0.0)}


def test_edge_ends_fan_out(spark):
    cards = spark.createDataFrame([("v", "hub", 0.0, 52.0), ("v", "l", -100.0, 52.0), ("v", "r", 100.0, 52.0)], "view string, node_id string, x double, width double")
    edges = [("v", "e1", "hub", "r"), ("v", "e0", "hub", "l"), ("v", "gone", "hub", "x")] + [("v", f"m{i}", "l", "hub") for i in range(4)]
    rows = layout.fan_out(cards, spark.createDataFrame(edges, "view string, edge_id string, source string, target string")).collect()
    at = {(r.edge_id, r.node_id): (r.anchor, r.x) for r in rows}
    assert at[("e0", "hub")] == ("s0", 14.0) and at[("e1", "hub")] == ("s1", 38.0) and at[("e1", "r")] == ("t0", 26.0)
    assert [at[(f"m{i}", "hub")] for i in range(4)] == [("t0", 14.0), ("t0", 14.0), ("t1", 26.0), ("t2", 38.0)]
    assert not [k for k in at if k[0] == "gone"]
    one = next(r for r in rows if r.edge_id == "e1" and r.node_id == "hub")
    assert (one.handle_x, one.handle_y) == (35.0, 52.0)


def test_a_whole_map_and_a_store_go_out_and_come_back(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("file:a.py", "file", "a.py", "a.py", "sum", None, "root", 3, "structural"), ("function:a.py:f", "function", "f", "a.py", "fn", (1, 2), None, None, "llm")],
        "node_id string, kind string, name string, path string, summary string, range struct<start_line:int,end_line:int>, layer string, significance int, provenance string")
    edges = spark.createDataFrame([("file:a.py", "function:a.py:f", "contains", 1.0)], "source string, target string, kind string, weight double")
    layers = spark.createDataFrame([("root", "root", "Files", "structural")], "layer_id string, name string, description string, provenance string")
    flows = spark.createDataFrame([("flow:x", "X", "root", ["function:a.py:f", "b"], "structural")], "flow_id string, name string, domain string, steps array<string>, provenance string")
    tour = spark.createDataFrame([(1, "file:a.py", "second"), (0, "file:a.py", "first")], "pos int, node_id string, label string")
    mapfile.write_map(nodes, edges, layers, f"{tmp_path}/m.json", "demo", flows=flows, tour=tour)
    back = mapfile.read_map(spark, f"{tmp_path}/m.json")
    assert sorted(map(str, back["nodes"].select(nodes.columns).collect())) == sorted(map(str, nodes.collect()))
    assert back["edges"].drop("seq").collect() == edges.collect() and back["project"].head().name == "demo"
    assert [tuple(r) for r in back["domain_flows"].select("id", "steps").collect()] == [("flow:x", ["function:a.py:f", "b"])]
    assert [r.label for r in back["tour"].orderBy("seq").collect()] == ["first", "second"] and back["layers"].head().description.text == "Files"
    texts = spark.createDataFrame([("annotations", "k é", "h1", "said"), ("flows", "flow:x", "h2", "named"), ("tour", "t", None, "x")], "section string, key string, hash string, text string")
    mapfile.write_store(texts, f"{tmp_path}/s.json", "provider", "2026-01-31")
    read = mapfile.read_store(spark, f"{tmp_path}/s.json")
    assert sorted(map(str, read.collect())) == sorted(map(str, texts.collect()))


def test_carry_over_from_a_store_holds_for_what_did_not_change(spark, tmp_path):
    steps = spark.createDataFrame([("r", "r", 0), ("r", "a", 1), ("r", "b", 2), ("q", "q", 0)], "root string, node_id string, pos int")
    keyed = lambda df: annotate.flow_inputs(df).select(F.col("root").alias("key"), "hash", F.lit("mechanical").alias("text"))
    mapfile.write_store(keyed(steps).select(F.lit("flows").alias("section"), "key", "hash", F.lit("told").alias("text")), f"{tmp_path}/s.json")
    moved = spark.createDataFrame([("r", "r", 0), ("r", "b", 1), ("r", "a", 2), ("q", "q", 0)], "root string, node_id string, pos int")
    got = annotate.reattach(keyed(moved), mapfile.read_store(spark, f"{tmp_path}/s.json"))
    assert {r.key: r.text for r in got.collect()} == {"r": "mechanical", "q": "told"}
    one = lambda label: annotate.tour_inputs(spark.createDataFrame([("file:a", label)], "node_id string, label string")).head()["hash"]
    assert one("a — fan-in 1") != one("a — fan-in 2") and one("foobar") == "fnv1a64:85944171f73967e8"


def plain_fnv(data):
    h = annotate.FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * annotate.FNV_PRIME % 2**64
    return f"fnv1a64:{h:016x}"


def test_readers_find_whole_versions_and_keep_theirs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/map"
    made = lambda n: CodeMap(make_nodes(spark, [file(f"m{n}/f{k}.ts") for k in range(n)]), make_edges(spark, [(f"file:m{n}/f0.ts", f"file:m{n}/f{n - 1}.ts", "imports")]))
    told = lambda m: (m.nodes.count(), [r.target for r in m.edges.collect()])
    with pytest.raises(FileNotFoundError):
        CodeMap.load(spark, path)
    made(2).publish(path)
    first = CodeMap.load(spark, path)
    # A writer that dies before its rename leaves the map as it was, whatever it has written.
    made(9).nodes.write.parquet(f"{path}/versions/dead/nodes")
    assert told(CodeMap.load(spark, path)) == (2, ["file:m2/f1.ts"])
    made(3).publish(path)
    assert told(first) == (2, ["file:m2/f1.ts"]) and told(CodeMap.load(spark, path)) == (3, ["file:m3/f2.ts"])
    # Readers beside writers see one version or another, never a part of two.
    with ThreadPoolExecutor(4) as pool:
        writers = [pool.submit(lambda n=n: made(n).publish(path)) for n in (4, 5, 6)]
        seen = [told(CodeMap.load(spark, path)) for _ in range(6)]
        [w.result() for w in writers]
    assert all(target == [f"file:m{n}/f{n - 1}.ts"] for n, target in seen)
    found = published.versions(spark, path)
    assert [n for n, _, _ in found] == sorted({n for n, _, _ in found}) and len(found) == 5
    assert published.reclaim(spark, path) == [] and len(published.reclaim(spark, path, 0)) == 4
    assert [v for _, v, _ in published.versions(spark, path)] == [found[-1][1]] and told(CodeMap.load(spark, path))[0] in (4, 5, 6)
    assert not (tmp_path / "map/versions" / found[0][1]).exists()


def test_input_hashes_are_those_of_the_joined_texts(spark):
    """Over keys that span many tasks, that share one, of one text and of empty ones."""
    rng = random.Random(4)
    rows = [(k, n, "".join(rng.choice("abcé/.漢") for _ in range(rng.randrange(30)))) for k, size in (("big", 900), ("b", 40), ("one", 1), ("é", 7)) for n in range(size)]
    rng.shuffle(rows)
    rows.append(("empty", 0, ""))
    got = annotate.joined_hash(spark.createDataFrame(rows, "k string, n int, said string").repartition(7), "k", "said", "n")
    want = {k: plain_fnv("\n".join(t for key, _, t in sorted(rows) if key == k).encode()) for k in {r[0] for r in rows}}
    assert {r.k: r["hash"] for r in got.collect()} == want
    data = bytes(rng.randrange(256) for _ in range(500))
    for cut_at in (0, 1, 77, 500):
        h = annotate.fnv_after(annotate.FNV_OFFSET, annotate.fnv_effect(data[:cut_at]), cut_at)
        assert f"fnv1a64:{annotate.fnv_after(h, annotate.fnv_effect(data[cut_at:]), 500 - cut_at):016x}" == plain_fnv(data)
    texts = [b"", b"x", *(bytes(rng.randrange(256) for _ in range(rng.randrange(60))) for _ in range(30)), data * 3]
    assert [f"fnv1a64:{h:016x}" for h in annotate.fnv_hashes(texts).tolist()] == list(map(plain_fnv, texts))


def test_only_keys_at_the_ends_of_a_task_are_put_together(spark, monkeypatch):
    made = []
    monkeypatch.setattr(annotate, "cut", lambda df, label="cut": made.append(session.cut(df, label)) or made[-1])
    rows = [(f"k{k:04d}", n, f"t{k}.{n}") for k in range(900) for n in range(k % 4 + 1)]
    got = annotate.joined_hash(spark.createDataFrame(rows, "k string, n int, said string").repartition(5), "k", "said", "n").collect()
    said: dict[str, list[str]] = {}
    for key, _, text in rows:
        said.setdefault(key, []).append(text)
    assert {r.k: r["hash"] for r in got} == {k: plain_fnv("\n".join(texts).encode()) for k, texts in said.items()}
    assert made[-1].where("effect IS NOT NULL").count() <= 2 * 4 * spark.sparkContext.defaultParallelism


def test_a_store_keeps_what_a_newer_writer_left(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"version": 2, "annotations": {"old": {"content_hash": "h", "summary": "s"}}, "notes": {"a": [1, {"b": null}]}, "extra": 3}')
    texts = spark.createDataFrame([("annotations", "k", "h1", "said")], "section string, key string, hash string, text string")
    mapfile.write_store(texts, str(path))
    held = json.loads(path.read_text())
    assert held["notes"] == {"a": [1, {"b": None}]} and held["extra"] == 3 and list(held["annotations"]) == ["k"]
    assert [r.key for r in mapfile.read_store(spark, str(path)).collect()] == ["k"]
    for name, text in (("other", '{"version": 1, "notes": 1}'), ("broken", "not json"), ("list", "[1]"), ("empty", "")):
        path = tmp_path / name
        path.write_text(text)
        mapfile.write_store(texts, str(path))
        assert set(json.loads(path.read_text())) == {"version", *mapfile.SECTIONS}
