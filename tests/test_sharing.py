"""Sharing maps, provider payloads, saved answers, entries and depths with cycles."""

import json
import random

import pytest

from graphloom import model
from graphloom.functions import text
from graphloom.operators import annotate, layout, redact, regions, retrieval
from pyspark.sql import functions as F


def write(path, document):
    path.write_text(json.dumps(document))
    return str(path)


DOCUMENT = {
    "version": "0.5.0", "project": {"name": "demo", "owner": "someone"}, "extra": 1,
    "nodes": [
        {"id": "file:a", "kind": "file", "name": "a", "path": "a", "summary": "plain", "provenance": "structural", "range": {"start_line": 1, "end_line": 2, "col": 3}},
        {"id": "file:b", "kind": "file", "name": "b", "path": "b", "summary": "told", "provenance": "llm", "secret": {"x": 1}},
        {"id": "file:c", "kind": "file", "name": "c", "path": "c", "summary": "unsaid"},
    ],
    "edges": [{"source": "file:a", "target": "file:b", "kind": "imports", "weight": 0.7}],
    "layers": [
        {"id": "x", "name": "X", "provenance": "structural", "description": {"text": "told", "provenance": "llm", "by": "m"}},
        {"id": "y", "name": "Why", "provenance": "llm", "description": {"text": "Files", "provenance": "structural"}},
    ],
    "tour": [{"node": "file:a", "label": "start", "provenance": "structural"}],
}


def test_nested_redaction_uses_each_objects_own_provenance(spark, tmp_path):
    lists, lost = redact.share(spark, write(tmp_path / "m.json", DOCUMENT))
    nodes = {r.id: r for r in lists["nodes"].collect()}
    assert [nodes[f"file:{x}"].summary for x in "abc"] == ["plain", redact.MARKER, redact.MARKER]
    assert "secret" not in lists["nodes"].columns and nodes["file:a"].range.asDict() == {"start_line": 1, "end_line": 2} and nodes["file:b"].range is None
    layers = {r.id: r for r in lists["layers"].collect()}
    assert (layers["x"].name, layers["x"].description.text) == ("X", redact.MARKER)
    assert (layers["y"].name, layers["y"].description.text) == (redact.MARKER, "Files")
    assert lists["project"].head().asDict() == {"name": "demo"} and "domain_flows" not in lists
    assert [tuple(r) for r in lost.collect()] == [
        ("KnowledgeGraph.extra", 1), ("Layer.name", 1), ("LayerDescription.by", 1), ("LayerDescription.text", 1),
        ("Node.secret", 1), ("Node.summary", 2), ("Project.owner", 1), ("Range.col", 1)]


@pytest.mark.parametrize("change", [
    {"nodes": [{"id": "file:a", "kind": "planet", "name": "a", "path": "a"}]},
    {"nodes": [{"id": "file:a", "kind": "file", "name": "a", "path": "a", "provenance": "guess"}]},
    {"nodes": [{"kind": "file", "name": "a", "path": "a"}]},
    {"edges": [{"source": "a", "target": "b", "kind": "likes"}]},
    {"layers": [{"id": "x", "name": "X", "description": "just text"}]},
])
def test_a_map_of_another_shape_is_not_shared(spark, tmp_path, change):
    with pytest.raises(Exception) as raised:
        lists, lost = redact.share(spark, write(tmp_path / "m.json", DOCUMENT | change))
        [df.collect() for df in (*lists.values(), lost)]
    assert any(word in str(raised.value) for word in ("contract", "MALFORMED", "PARSE"))


def test_answers_are_read_strictly():
    assert annotate.parse_answers('{"answers": [{"key": "a", "text": "x"}]}') == {"a": "x"}
    for bad in ("no", "[]", '{"answers": {}}', '{"answers": [{"key": "a"}]}', '{"answers": [{"key": "a", "text": 1}]}', '{"answers": null}'):
        with pytest.raises(ValueError):
            annotate.parse_answers(bad)


def test_saved_answers_outlive_a_failure_and_are_not_asked_again(spark, tmp_path):
    slots = spark.createDataFrame([(f"s{i:03d}", 0, "p") for i in range(130)], "slot_key string, family int, payload string")
    path = f"{tmp_path}/saved"

    def refuses(batch):
        if batch[0][0] == "s050":
            raise RuntimeError("limit")
        return {k: "first" for k, _ in batch}

    with pytest.raises(RuntimeError, match="50 slots.*limit"):
        annotate.fill_saved(slots, refuses, path, workers=3)
    kept = spark.read.parquet(path)
    assert {r.slot_key for r in kept.collect()} == {f"s{i:03d}" for i in range(50)}
    out = annotate.fill_saved(slots, lambda batch: {k: "second" for k, _ in batch}, path, workers=3).collect()
    assert {r.slot_key: r.answer for r in out} == {f"s{i:03d}": "first" if i < 50 else "second" for i in range(130)} and len(out) == 130

    def never(batch):
        raise AssertionError

    assert annotate.fill_saved(slots, never, path).count() == 130
    assert annotate.fill_saved(slots.limit(0), never, f"{tmp_path}/none").count() == 0


def test_payloads_know_members_steps_and_degrees(spark):
    nodes = spark.createDataFrame(
        [("file:r.py", "file", "r.py", "r.py", "", "root", "structural"), ("file:s.py", "file", "s.py", "s.py", "said", "root", "llm")], model.NODE)
    layers = spark.createDataFrame([("root", "root", "Files", "structural")], "layer_id string, name string, description string, provenance string")
    steps = spark.createDataFrame([("f", f"n{i:02d}", i) for i in range(12)], "root string, node_id string, pos int")
    flows = spark.createDataFrame([("flow:f", "root", "F", 12)], "flow_id string, domain string, name string, n_steps long")
    tour = spark.createDataFrame([(0, "file:r.py", "L")], "pos int, node_id string, label string")
    degrees = spark.createDataFrame([("file:r.py", "r.py", 3, 4)], "node_id string, path string, fan_in long, fan_out long")
    got = {r.slot_key: json.loads(r.payload) for r in annotate.slot_payloads(nodes, layers, flows, steps, tour, degrees).collect()}
    assert set(got) == {"summary:file:r.py", "layer-name:root", "layer-description:root", "flow-name:flow:f", "tour-label:file:r.py"}
    assert got["layer-name:root"]["member_files"] == 2
    flow = got["flow-name:flow:f"]
    assert flow["steps"] == [f"n{i:02d}" for i in range(10)] and flow["step_count"] == 12 and flow["entry_point"] == "n00"
    assert (got["tour-label:file:r.py"]["fan_in"], got["tour-label:file:r.py"]["fan_out"]) == (3, 4)


def test_hashes_of_missing_files_match_nothing(spark):
    nodes = spark.createDataFrame([("file:a", "a"), ("function:a:f", "a"), ("file:b", "b"), ("file:c", "c")], "node_id string, path string")
    texts = spark.createDataFrame([("a", "foobar"), ("b", None)], "path string, text string")
    got = {r.node_id: r["hash"] for r in annotate.file_hashes(nodes, texts).collect()}
    assert got == {"file:a": "fnv1a64:85944171f73967e8", "function:a:f": "fnv1a64:85944171f73967e8", "file:b": None, "file:c": None}


def test_entries_follow_flows_or_else_callers(spark):
    nodes = spark.createDataFrame([(i, "class" if i == "z" else "function", i, "p", "", None, "structural") for i in "abcz"], model.NODE)
    edges = spark.createDataFrame([("z", "a", "calls", 0.9), ("b", "a", "calls", 0.9), ("a", "c", "calls", 0.9)], model.EDGE)
    flows = spark.createDataFrame([(0, ["c"]), (1, ["gone"]), (2, ["a", "b"]), (3, ["c"]), (4, [])], "seq int, steps array<string>")
    ids = lambda df: [r.node_id for r in df.orderBy("rank").collect()]
    assert ids(regions.flow_entries(nodes, edges, flows)) == ["c", "a"]
    assert ids(regions.flow_entries(nodes, edges, flows.limit(0))) == ids(regions.flow_entries(nodes, edges)) == ["b", "z"]


def test_significance_flag_and_known_stops(spark):
    nodes = spark.createDataFrame([("file:a", "file", 0), ("function:a:f", "function", None)], "node_id string, kind string, significance int")
    flag = lambda df: regions.publishes_significance(df).head().published
    assert flag(nodes) and not flag(nodes.where("kind <> 'file'")) and not flag(nodes.drop("significance")) and not flag(nodes.limit(0))
    tour = spark.createDataFrame([(0, "file:a"), (1, "file:gone")], "pos int, node_id string")
    assert [r.pos for r in regions.known_stops(tour, nodes).collect()] == [0]


def test_citations_of_turns_are_clamped(spark):
    talk = spark.createDataFrame([("c", t, "q", "a", [f"{i}" + "x" * 600 for i in range(50)]) for t in range(8)], "conv_id string, turn int, question string, answer string, citations array<string>")
    got = retrieval.clamped_turns(talk).orderBy("turn").collect()
    assert [r.turn for r in got] == [2, 3, 4, 5, 6, 7]
    assert all(len(r.citations) == 40 and all(len(c) == 501 and c.endswith("…") for c in r.citations) for r in got)


def test_depths_leave_back_links_out(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for view in ("v", "w"):
        ids = [f"n{i:02d}" for i in range(12)]
        links = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(24)})
        rows += [(view, a, b) for a, b in links]
        back = {(r.source, r.target) for r in layout.back_links(spark.createDataFrame([(view, a, b) for a, b in links], "view string, source string, target string")).collect()}
        assert back
        depth = {i: 0 for link in links for i in link}
        for _ in ids:
            for a, b in links:
                if (a, b) not in back and a != b:
                    depth[b] = max(depth[b], depth[a] + 1)
        want |= {(view, i): d for i, d in depth.items()}
    got = layout.view_depths(spark.createDataFrame(rows, "view string, source string, target string")).collect()
    assert {(r.view, r.node_id): r.depth for r in got} == want


def test_numbers_and_dates(spark):
    days = spark.createDataFrame([(0, 1234567), (11016, 999), (-1, 0), (19782, -1000)], "d int, n long")
    got = [tuple(r) for r in days.select(text.civil_date(F.col("d")), text.thousands(F.col("n"))).collect()]
    assert got == [("1970-01-01", "1,234,567"), ("2000-02-29", "999"), ("1969-12-31", "0"), ("2024-02-29", "-1,000")]


def test_small_views(spark, tmp_path):
    from graphloom.codemap import CodeMap
    from graphloom.functions import text
    from graphloom.operators import graph, retrieval
    from test_sources import sample

    made = sample(spark)
    assert {r.region for r in made.regions().collect()} == {"root", "lib"} and made.regions("domain").count() >= 1
    with pytest.raises(ValueError):
        made.regions("other")
    edges = made.edges.withColumn("edge_seq", F.monotonically_increasing_id())
    way = graph.path_steps(made.nodes, edges, "file:app.ts", "file:lib/util.ts")
    assert [(r.pos, r.node_id, r.path) for r in way.orderBy("pos").collect()] == [(0, "file:app.ts", "app.ts"), (1, "file:lib/util.ts", "lib/util.ts")]
    assert {r.node_id for r in graph.highlighted(made.nodes, way).where("on_path").collect()} == {"file:app.ts", "file:lib/util.ts"}
    none = graph.path_steps(made.nodes, edges, "file:app.ts", "file:gone")
    assert none.count() == 0 and graph.highlighted(made.nodes, none).where("on_path").count() == 0
    at = made.export(str(tmp_path), "  My projéct / x ")
    assert at.endswith("/My-proj-ct-x-map.json") and json.loads(open(at).read())["project"]["name"] == "  My projéct / x "
    said = spark.range(3).select(text.counted(F.col("id"), "file").alias("c"), text.subject(F.col("id"), "region", "leans", "lean").alias("s")).collect()
    assert [tuple(r) for r in said] == [("0 files", "0 regions lean"), ("1 file", "1 region leans"), ("2 files", "2 regions lean")]
    hints = spark.createDataFrame([("llm",), ("structural",), (None,)], "p string").select(text.enrichment_hint(F.col("p")).alias("h")).collect()
    assert [r.h is None for r in hints] == [True, False, False]
    rows = [("a", n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(17)] + [("b", 0, "user", "q"), ("c", 0, "assistant", "x")]
    told = {r.conv_id: r for r in retrieval.carried(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert [t.turn for t in told["a"].turns] == [4, 6, 8, 10, 12, 14] and told["a"].in_flight
    assert told["b"].turns == [] and told["b"].in_flight and not told["c"].in_flight
