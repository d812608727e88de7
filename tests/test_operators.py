"""Operators on small literal graphs, and against brute force on random ones."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.operators import annotate, extract, graph, overlay, redact, regions, resolve, retrieval, semantics


def make_nodes(spark, rows):
    full = [(i, k, n, p, s, p.split("/")[0] if k == "file" and "/" in p else ("root" if k == "file" else None), "structural") for i, k, n, p, s in rows]
    return spark.createDataFrame(full, model.NODE)


def make_edges(spark, rows):
    return spark.createDataFrame([(a, b, k, model.WEIGHTS[k]) for a, b, k in rows], model.EDGE)


def fn(path, name):
    return (f"function:{path}:{name}", "function", name, path, f"Function {name}")


def file(path):
    return (f"file:{path}", "file", path.split("/")[-1], path, "")


def test_flow_names_and_self_recursion(spark):
    nodes = make_nodes(spark, [file("a/x.ts"), fn("a/x.ts", "main"), fn("a/x.ts", "greet"), fn("a/x.ts", "loop")])
    f = "function:a/x.ts:"
    edges = make_edges(spark, [(f + "main", f + "greet", "calls"), (f + "loop", f + "loop", "calls")])
    flows = semantics.flows(nodes, semantics.flow_steps(nodes, edges)).collect()
    assert [(r.flow_id, r.domain, r.name, r.n_steps) for r in flows] == [("flow:" + f + "main", "a", "main → greet", 2)]


@pytest.mark.parametrize("cyclic", [False, True])
def test_flow_steps_match_depth_first_walk_on_random_graphs(spark, cyclic):
    rng = random.Random(3)
    ids = [f"n{i:02d}" for i in range(14)]
    # With cycles the first two nodes stay uncalled, so that there are roots.
    pairs = sorted({(a, b) for a in ids for b in ids if (b > "n01" if cyclic else a < b) and rng.random() < (0.12 if cyclic else 0.22)})
    nodes = make_nodes(spark, [(i, "function", i, "p.ts", "") for i in ids])
    got: dict[str, list[str]] = {}
    for r in semantics.flow_steps(nodes, make_edges(spark, [(a, b, "calls") for a, b in pairs])).orderBy("root", "pos").collect():
        got.setdefault(r.root, []).append(r.node_id)
    called, after = {b for _, b in pairs}, {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    want = {}
    for root in [i for i in after if i not in called]:
        steps, stack = [], [root]
        while stack:
            at = stack.pop()
            if at not in steps:
                steps.append(at)
                stack += sorted(after.get(at, []), reverse=True)
        want[root] = steps
    assert got == want


def test_flow_steps_place_leaves_that_many_ways_reach(spark, monkeypatch):
    monkeypatch.setattr(semantics, "BLOCK", 2)
    monkeypatch.setattr(semantics, "WAYS", 2)
    rng = random.Random(5)
    ids = [f"n{i:02d}" for i in range(26)]
    # Only every third node calls, so most are leaves, and names of callers and leaves are mingled; one call is there twice.
    pairs = sorted({(a, b) for a in ids[::3] for b in ids if a < b and rng.random() < 0.5})
    nodes = make_nodes(spark, [(i, "function", i, "p.ts", "") for i in ids])
    steps = semantics.flow_steps(nodes, make_edges(spark, [(a, b, "calls") for a, b in [*pairs, pairs[0]]]))
    got = {}
    for r in steps.orderBy("root", "pos").collect():
        got.setdefault(r.root, []).append((r.pos, r.node_id))
    called, want = {b for _, b in pairs}, {}
    for root in {a for a, _ in pairs} - called:
        walk, stack = [], [root]
        while stack:
            at = stack.pop()
            if at not in walk:
                walk.append(at)
                stack += sorted((b for a, b in pairs if a == at), reverse=True)
        want[root] = list(enumerate(walk))
    assert got == want
    # Leaves are not followed and no way to them is kept: only the ids of a block are.
    plan = steps._jdf.queryExecution().analyzed().toString()
    assert not any("way" in c for c in re.findall(r"RepartitionByExpression.*", plan)) and "explode(targets" in plan


def test_tour_has_twelve_stops_and_no_isolated_file(spark):
    hub = file("src/hub.ts")
    others = [file(f"src/f{i:02d}.ts") for i in range(30)]
    alone = [file(f"src/z{i}.ts") for i in range(5)]
    nodes = make_nodes(spark, [hub, *others, *alone])
    edges = make_edges(spark, [(o[0], hub[0], "imports") for o in others])
    stops = semantics.tour(semantics.significance(nodes, edges)).orderBy("pos").collect()
    assert len(stops) == 12 and stops[-1].node_id == hub[0]
    assert stops[-1].label == "src/hub.ts — fan-in 30, fan-out 0"
    assert not {s.node_id for s in stops} & {a[0] for a in alone}


def test_overlay_covers_symbols_and_both_directions(spark):
    nodes = make_nodes(spark, [file("app.ts"), file("util.ts"), fn("app.ts", "main"), fn("util.ts", "help"), file("far.ts")])
    edges = make_edges(spark, [
        ("file:app.ts", "file:util.ts", "imports"), ("file:app.ts", "function:app.ts:main", "contains"),
        ("function:app.ts:main", "function:util.ts:help", "calls"), ("file:util.ts", "function:util.ts:help", "contains"),
    ])
    changed = spark.createDataFrame([("util.ts",), ("gone.ts",)], "path string")
    marks = {r.node_id: r.status for r in overlay.overlay(nodes, edges, changed).collect()}
    assert marks == {
        "file:util.ts": "changed", "function:util.ts:help": "changed", "file:app.ts": "affected", "function:app.ts:main": "affected"}
    assert [r.path for r in overlay.unmapped_paths(nodes, changed).collect()] == ["gone.ts"]
    rolled = {r.node_id: r.status for r in overlay.rolled_up(nodes, overlay.overlay(nodes, edges, changed)).collect()}
    assert rolled == {"file:util.ts": "changed", "file:app.ts": "affected"}


def test_shortest_path_against_breadth_first_search(spark):
    rng = random.Random(5)
    ids = [f"v{i:02d}" for i in range(18)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(26)]
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "source string, target string, edge_seq long")
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id string")
    around: dict[str, list[str]] = {}
    for a, b in pairs:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    for start, end in [("v00", "v09"), ("v03", "v03"), ("v01", "nowhere"), ("v02", "v17")]:
        parent, queue = {start: None}, deque([start])
        while queue:
            at = queue.popleft()
            for to in around.get(at, []):
                if to not in parent:
                    parent[to] = at
                    queue.append(to)
        want, at = [], end if end in parent else None
        while at is not None:
            want.append(at)
            at = parent[at]
        got = [r.node_id for r in graph.shortest_path(nodes, edges, start, end).orderBy("pos").collect()]
        assert got == want[::-1]


def test_depth_is_the_longest_way_and_cycles_are_refused(spark):
    import pytest

    links = lambda pairs: spark.createDataFrame(pairs, "source string, target string")
    got = {r.node_id: r.depth for r in graph.dependency_depth(links([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(ValueError):
        graph.dependency_depth(links([("a", "b"), ("b", "c"), ("c", "b")]))


def test_dangling_edges_are_reported_and_skipped(spark):
    nodes = make_nodes(spark, [file("a/x.ts")])
    edges = make_edges(spark, [("file:a/x.ts", "file:b/none.ts", "imports")])
    assert [(r.rule, r.subject) for r in model.violations(nodes, edges).collect()] == [("dangling edge", "file:b/none.ts")]
    member = regions.file_regions(nodes)
    assert regions.region_links(nodes, edges, member).count() == 0
    assert regions.region_weight(edges, regions.node_regions(nodes, member)).collect()[0].weight == 1


def test_language_of_paths(spark):
    paths = ["a/b.ts", "x.HPP", "y.hxx", "z.markdown", ".gitignore", "Makefile", "q.mts"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(regions.language_of(F.col("path")).alias("l")).collect()
    assert [r.l for r in rows] == ["TypeScript", "C++", "Other", "Other", "Other", "Other", "TypeScript"]


def test_path_normalisation(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "../a": None, "a/../../b": None, ".": "", "a/b/..": "a"}
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", resolve.normalised(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == cases


def resolved(spark, candidates, files, imports):
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    rows = spark.createDataFrame([(p, k, s) for k, (p, s) in enumerate(imports)], "path string, import_seq long, specifier string")
    found = resolve.first_match(rows, candidates(F.col("path"), F.col("specifier")), paths).collect()
    return {imports[r.import_seq]: r.target for r in found}


def test_es_resolution_order(spark):
    files = ["src/a.ts", "src/a.js", "src/lib/index.ts", "src/b.tsx", "top.ts"]
    imports = [("src/m.ts", "./a"), ("src/m.ts", "./a.js"), ("src/m.ts", "./lib"), ("src/m.ts", "./b.jsx"), ("src/m.ts", "../top"), ("src/m.ts", "lib"), ("src/m.ts", "../../top"), ("src/lib/x.ts", ".")]
    assert resolved(spark, resolve.es_candidates, files, imports) == {
        ("src/m.ts", "./a"): "src/a.ts", ("src/m.ts", "./a.js"): "src/a.js", ("src/m.ts", "./lib"): "src/lib/index.ts",
        ("src/m.ts", "./b.jsx"): "src/b.tsx", ("src/m.ts", "../top"): "top.ts", ("src/lib/x.ts", "."): "src/lib/index.ts"}


def test_python_and_include_resolution(spark):
    files = ["pkg/__init__.py", "pkg/util.py", "pkg/sub/mod.py", "util.py"]
    imports = [("pkg/sub/mod.py", "..util"), ("pkg/sub/mod.py", "pkg"), ("pkg/m.py", "util"), ("pkg/m.py", ".sub.mod"), ("pkg/m.py", "os")]
    assert resolved(spark, resolve.python_candidates, files, imports) == {
        ("pkg/sub/mod.py", "..util"): "pkg/util.py", ("pkg/sub/mod.py", "pkg"): "pkg/__init__.py",
        ("pkg/m.py", "util"): "util.py", ("pkg/m.py", ".sub.mod"): "pkg/sub/mod.py"}
    heads = ["inc/a.h", "src/a.h"]
    asked = [("src/m.c", "a.h"), ("src/m.c", "inc/a.h"), ("src/m.c", "<inc/a.h>")]
    assert resolved(spark, resolve.include_candidates, heads, asked) == {("src/m.c", "a.h"): "src/a.h", ("src/m.c", "inc/a.h"): "inc/a.h"}


def test_nearest_shares_most_leading_segments(spark):
    wanted = spark.createDataFrame([("a/b/c/x.rs", "core")], "path string, name string")
    named = spark.createDataFrame([("core", "a/z/src"), ("core", "a/b/src"), ("core", "a/b/arc"), ("other", "a/b/c")], "name string, src_dir string")
    assert [r.src_dir for r in resolve.nearest(wanted, named).collect()] == ["a/b/arc"]


def test_markdown_fences_and_schemes(spark):
    text = "[a](b.md)\n```\n[no](no.md)\n```\n[m](mailto:x) [abs](/x.md) [h](#top)\n  [r]: c/d.md\n~~~\n[r]: e.md"
    rows = extract.markdown_links(spark.createDataFrame([("p.md", text), ("q.md", None)], "path string, text string"))
    assert [(r.path, r.target) for r in rows.orderBy("pos").collect()] == [("p.md", "b.md"), ("p.md", "c/d.md")]


def test_terms_scores_and_slice(spark):
    nodes = make_nodes(spark, [("file:a", "file", "parser", "src/parser.ts", ""), ("class:b", "class", "x", "y", "a parser" ), ("function:c", "function", "x", "y", "z" * 400 + " parser")])
    scored = {r.node_id: r.score for r in retrieval.scored_nodes(nodes, "Where is the PARSER?").collect()}
    assert scored == {"file:a": 3, "class:b": 1, "function:c": 0}
    cited = spark.createDataFrame([("function:c", 1), ("invented", 0)], "node_id string, cite_rank long")
    assert [r.node_id for r in retrieval.context_slice(nodes, "parser", cited).orderBy("rank").collect()] == ["function:c", "file:a", "class:b"]


def test_reattach_needs_key_and_hash(spark):
    now = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m"), ("c", None, "m")], "key string, hash string, text string")
    then = spark.createDataFrame([("a", "1", "t"), ("b", "9", "t"), ("c", None, "t")], "key string, hash string, text string")
    got = {r.key: (r.text, r.provenance) for r in annotate.reattach(now, then).collect()}
    assert got == {"a": ("t", "llm"), "b": ("m", "structural"), "c": ("m", "structural")}


def test_content_hash_known_value(spark):
    rows = spark.createDataFrame([("foobar",), (None,)], "t string").select(annotate.content_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == ["fnv1a64:85944171f73967e8", None]


def test_fill_asks_once_for_each_batch(spark):
    slots = spark.createDataFrame([(f"s{i:03d}", 0, "p") for i in range(60)], "slot_key string, family int, payload string")
    answers = annotate.fill(slots, lambda batch: {k: f"{len(batch)}" for k, _ in batch}, 2).collect()
    assert sorted(r.answer for r in answers) == ["10"] * 10 + ["25"] * 50


def test_redaction_fails_closed(spark):
    rows = [("file:a", "file", "a", "a", "one", "root", "structural"), ("file:b", "file", "b", "b", "two", "root", "llm"), ("file:c", "file", "c", "c", "three", "root", None)]
    nodes = spark.createDataFrame(rows, model.NODE).withColumn("extra", F.lit(1))
    out = redact.redacted(nodes, "nodes")
    assert "extra" not in out.columns
    assert {r.node_id: r.summary for r in out.collect()} == {"file:a": "one", "file:b": "[redacted]", "file:c": "[redacted]"}
    assert {r.field: r.n for r in redact.disclosure(nodes, "nodes").collect()} == {"nodes.summary": 2, "nodes.extra": 3}


def test_plural_and_summary(spark):
    row = spark.range(1).select(
        extract.plural(F.lit("class"), F.lit(2)).alias("a"), extract.plural(F.lit("function"), F.lit(1)).alias("b"),
        extract.file_summary(F.lit("Go"), F.lit(1), F.lit(2), F.lit(1)).alias("c")).head()
    assert tuple(row) == ("classes", "function", "Go file, 1 line: 2 functions, 1 class")


def test_few_changes_leave_the_edges_where_they_are(spark):
    # Spark can't tell from such a plan that few paths change, so nodes and edges were dealt out for them.
    nodes = spark.range(40).selectExpr("concat('file:', id) AS node_id", "concat('', id) AS path")
    edges = spark.range(39).selectExpr("concat('file:', id) AS source", "concat('file:', id + 1) AS target")
    changed = spark.range(5_000_000).where("id IN (3, 20)").selectExpr("concat('', id) AS path")
    hit = overlay.changed_nodes(nodes, changed)
    near = overlay.blast_radius(edges, hit)
    for df, joins in ((hit, 1), (near, 3)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") >= joins and "SortMergeJoin" not in plan
    assert sorted(r.node_id for r in near.collect()) == ["file:19", "file:2", "file:21", "file:4"]


def test_entry_points_are_of_the_rows_at_hand(spark):
    # Entries have their paths; they were looked up among all nodes once more.
    nodes = make_nodes(spark, [fn("b.py", "x"), fn("a.py", "y"), fn("a.py", "z")])
    edges = make_edges(spark, [("function:b.py:x", "function:a.py:z", "calls"), ("function:a.py:y", "function:a.py:z", "calls")])
    first = regions.entry_points(nodes, semantics.entry_functions(nodes, edges))
    assert [tuple(r) for r in first.orderBy("rank").collect()] == [(1, "function:a.py:y"), (2, "function:b.py:x")]
    assert first._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_flows_of_one_call_are_not_dealt_out(spark):
    # Steps of entries whose callees call nothing stand in the callees' rows; they went through four shuffles, and one for names.
    many = [f"f{i:03d}" for i in range(600)]
    nodes = make_nodes(spark, [fn("a/a.py", "top"), fn("b/b.py", "two"), *(fn("c.py", n) for n in many)])
    top, two, leaf = "function:a/a.py:top", "function:b/b.py:two", [f"function:c.py:{n}" for n in many]
    calls = [*((top, x, "calls") for x in leaf), (top, leaf[0], "calls"), (two, leaf[7], "calls"), (two, "gone", "calls")]
    steps = semantics.rooted_steps(nodes, make_edges(spark, calls), named=True)
    assert "Exchange" not in steps._jdf.queryExecution().sparkPlan().toString() and "Join" not in steps._jdf.queryExecution().optimizedPlan().toString()
    want = [(top, "a/a.py", n, p, n.split(":")[-1]) for p, n in enumerate([top, *leaf])]
    want += [(two, "b/b.py", two, 0, "two"), (two, "b/b.py", leaf[7], 1, "f007"), (two, "b/b.py", "gone", 2, "gone")]
    assert sorted(tuple(r) for r in steps.select("root", "path", "node_id", "pos", "name").collect()) == sorted(want)
    flows = {r.flow_id: (r.domain, r.name, r.n_steps) for r in semantics.flows(nodes, steps).collect()}
    assert flows == {f"flow:{top}": ("a", " → ".join(["top", *many]), 601), f"flow:{two}": ("b", "two → f007 → gone", 3)}
    assert {tuple(r) for r in semantics.flow_roots(nodes, make_edges(spark, calls)).collect()} == {(k, v[0]) for k, v in flows.items()}


def test_flows_that_are_walked_stand_beside_those_that_are_not(spark):
    nodes = make_nodes(spark, [fn("a.py", n) for n in "rstxyz"])
    at = "function:a.py:".__add__
    calls = [("r", "s"), ("r", "x"), ("s", "t"), ("s", "z"), ("t", "s"), ("y", "x"), ("y", "z")]
    edges = make_edges(spark, [(at(a), at(b), "calls") for a, b in calls]).unionByName(
        spark.createDataFrame([(at("x"), None, "calls", 0.9)], model.EDGE))
    steps = semantics.rooted_steps(nodes, edges, named=True).orderBy("root", "pos").collect()
    assert [(r.root[-1], r.name, r.pos, r.path) for r in steps] == [
        ("r", "r", 0, "a.py"), ("r", "s", 1, "a.py"), ("r", "t", 2, "a.py"), ("r", "z", 3, "a.py"), ("r", "x", 4, "a.py"),
        ("y", "y", 0, "a.py"), ("y", "x", 1, "a.py"), ("y", "z", 2, "a.py")]
    plain = semantics.flow_steps(nodes, edges).orderBy("root", "pos").collect()
    assert [(r.root, r.node_id, r.pos) for r in plain] == [(r.root, r.node_id, r.pos) for r in steps]


def test_a_flow_is_put_together_before_its_steps_are_rows(spark):
    # Every step was a row that was made distinct, numbered and joined with its root's path, which dealt all of them out once more.
    nodes = make_nodes(spark, [fn("a.py", n) for n in "rstxyz"])
    at = "function:a.py:".__add__
    calls = [("r", "s"), ("r", "x"), ("s", "t"), ("t", "x"), ("t", "y"), ("s", "z")]
    steps = semantics.flow_steps(nodes, make_edges(spark, [(at(a), at(b), "calls") for a, b in calls]))
    walked = steps._jdf.queryExecution().optimizedPlan().toString().split("posexplode")[-1]
    made, moved, joined = (walked.index(w) for w in ("array_distinct", "RepartitionByExpression", "Join"))
    assert made < moved < joined and "posexplode(targets" in steps._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.node_id[-1], r.pos) for r in steps.orderBy("pos").collect()] == [("r", 0), ("s", 1), ("t", 2), ("x", 3), ("y", 4), ("z", 5)]


@pytest.mark.parametrize("listed, rows, block", [(0, 8, 256), (1_000, 0, 2), (3, 1, 1)])
def test_flows_too_large_for_a_list_are_put_in_order_row_by_row(spark, monkeypatch, listed, rows, block):
    rng = random.Random(8)
    ids = [f"n{i:02d}" for i in range(24)]
    pairs = {(a, b) for a in ids[::2] for b in ids if b > "n03" and rng.random() < 0.25} | {("n00", "n04"), ("n02", "n05")}
    nodes = make_nodes(spark, [(i, "function", i, f"{i}.ts", "") for i in ids])
    edges = make_edges(spark, [(a, b, "calls") for a, b in [*sorted(pairs), ("n00", "n04")]])
    found = lambda: sorted(tuple(r) for r in semantics.rooted_steps(nodes, edges, named=True).select("root", "path", "node_id", "name", "pos").collect())
    want = found()
    assert {(r[0], r[1]) for r in want} == {("n00", "n00.ts"), ("n02", "n02.ts")} and len(want) > 20
    for name, value in (("LISTED", listed), ("ROWS", rows), ("BLOCK", block)):
        monkeypatch.setattr(semantics, name, value)
    assert found() == want


def test_names_of_flows_that_ids_do_not_tell(spark):
    # A name that ends its id isn't shuffled beside it; other names and ids without a node are.
    nodes = make_nodes(spark, [fn("a.py", "r"), ("function:a.py:x", "function", "other", "a.py", ""), fn("a.py", "y"), ("function:a.py:z", "function", None, "a.py", "")])
    edges = make_edges(spark, [("function:a.py:r", t, "calls") for t in ("function:a.py:x", "function:a.py:y", "function:a.py:z", "gone:q")])
    steps = semantics.rooted_steps(nodes, edges, named=True)
    assert [r.name for r in steps.orderBy("pos").collect()] == ["r", "other", "y", "function:a.py:z", "gone:q"]
    nodes = make_nodes(spark, [fn("a.py", "r"), *(fn("b.py", f"make{i}") for i in range(9))])
    edges = make_edges(spark, [("function:a.py:r", f"function:b.py:make{i}", "calls") for i in range(9)])
    assert semantics.flows(nodes, semantics.rooted_steps(nodes, edges, named=True)).head().name == " → ".join(["r", *(f"make{i}" for i in range(9))])


def test_few_touching_edges_leave_edges_and_nodes_where_they_are(spark):
    # Spark can't tell from such a plan that few edges touch the focus, so nodes were dealt out for their names.
    nodes = spark.range(5_000_000).selectExpr("concat('file:', id) AS node_id", "concat('f', id) AS name", "'file' AS kind", "concat('', id) AS path")
    edges = spark.range(4_999_999).selectExpr("concat('file:', id) AS source", "concat('file:', id + 1) AS target", "'imports' AS kind")
    focus = spark.range(5_000_000).where("id IN (3, 20)").selectExpr("concat('file:', id) AS node_id")
    found, near = graph.touching(nodes, edges, focus), graph.neighbourhood(nodes, edges, focus)
    for df in (found, near):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = sorted((r.node_id, r.other, r.other_name, r.direction) for r in found.collect())
    assert got == [("file:20", "file:19", "f19", "used by"), ("file:20", "file:21", "f21", "uses"), ("file:3", "file:2", "f2", "used by"), ("file:3", "file:4", "f4", "uses")]
    assert sorted(r.path for r in near.collect()) == ["19", "2", "20", "21", "3", "4"]


@pytest.mark.parametrize("few", [0, 100_000])
def test_a_tour_is_chosen_from_its_contenders(spark, monkeypatch, few):
    monkeypatch.setattr(semantics, "FEW", few)
    rng = random.Random(few)
    paths = [f"d/{i:02d}.ts" for i in range(30)]
    funcs = [fn(p, f"g{k}") for p in paths for k in range(2)]
    nodes = make_nodes(spark, [*map(file, paths), *funcs])
    links = [(f"file:{rng.choice(paths)}", f"file:{rng.choice(paths[:12])}", "imports") for _ in range(50)]
    calls = [(rng.choice(funcs)[0], rng.choice(funcs)[0], "calls") for _ in range(20)]
    rows = lambda df, stops: [tuple(r) for r in semantics.tour_selection(df, stops).collect()]
    for edges, stops in ((make_edges(spark, links + calls), 3), (make_edges(spark, links[:4] + calls), 12)):
        left, scored = semantics.contenders(nodes, edges, stops), semantics.significance(nodes, edges)
        assert rows(left, stops) == rows(scored, stops) and set(left.collect()) <= set(scored.collect())
    assert semantics.contenders(nodes.limit(0), edges).count() == 0


def test_only_contenders_are_looked_at_for_entries(spark):
    # a ties with b by its entry and comes before it; d has one as well but can't come so far. All functions were dealt out.
    a, b, c, d = (file(f"{x}.ts") for x in "abcd")
    nodes = make_nodes(spark, [a, b, c, d, fn("a.ts", "f"), fn("a.ts", "g"), fn("d.ts", "f")])
    edges = make_edges(spark, [
        *[(x[0], x[0], "imports") for x in (b, b, c, c, a)], (a[0], b[0], "imports"), (c[0], d[0], "imports"), ("file:gone", a[0], "imports"),
        ("function:a.ts:f", "function:a.ts:g", "calls"), ("function:d.ts:f", "function:a.ts:g", "calls")])
    left = semantics.contenders(nodes, edges, 2)
    assert sorted((r.path, r.fan_in + r.fan_out, r.is_entry) for r in left.collect()) == [("a.ts", 4, True), ("b.ts", 5, False), ("c.ts", 5, False)]
    assert [r.path for r in semantics.tour_selection(left, 2).collect()] == ["a.ts", "b.ts"]
