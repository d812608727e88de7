"""A small source tree, end to end: symbols, imports and calls, with decoys."""

import pytest

from graphloom.operators import semantics
from graphloom.session import cut
from graphloom.sources import repository

TREE = {
    "web/app.ts": (
        "import { greet as hi, shout } from './lib';\nimport * as util from './util.js';\nimport fs from 'fs';\n"
        "export function main() {\n  hi('x');\n  util.help();\n  fs.read();\n  local();\n}\nfunction local() { return 'call(';\n}\n"
        "export class Box {\n  open(n: number): void {\n    shout();\n  }\n}\nexport const arrow = (a: number) => {\n  main();\n};\n"
    ),
    "web/lib/index.ts": "export { greet } from '../greet';\nexport function shout() {\n}\n",
    "web/greet.ts": "export function greet() {\n}\nfunction hidden() {\n}\n",
    "web/util.ts": "export function help() {\n}\n",
    "pkg/__init__.py": "",
    "pkg/core.py": (
        "from . import tools\nfrom .tools import run as go_run, _secret\nimport pkg.tools as t\nimport os\n\n"
        "def start():\n    go_run()\n    tools.run()\n    t.run()\n    os.getcwd()\n    _secret()\n\n"
        "class Job:\n    def act(self):\n        start()\n\ndef broken(:\n    start()\n"
    ),
    "pkg/tools.py": "def run():\n    pass\n\n\ndef _secret():\n    pass\n",
    "go.mod": "module example.com/demo\n\ngo 1.22\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tst "example.com/demo/store"\n)\n\nfunc main() {\n\tst.Open()\n\tfmt.Println("Open(")\n\thelper()\n}\n',
    "cmd/help.go": "package main\n\nfunc helper() {\n}\n",
    "store/store.go": "package store\n\ntype DB struct {\n}\n\nfunc (d *DB) Close() {\n}\n",
    "store/open.go": "package store\n\nfunc Open() {\n}\n\nfunc hidden() {\n}\n",
    "c/main.c": '#include "calc.h"\n#include <stdio.h>\n\nstatic int twice(int x)\n{\n    return add(x, x);\n}\n\nint main(void) {\n    twice(2);\n    printf("add(");\n    hidden();\n    return 0;\n}\n',
    "c/calc.h": "int add(int a, int b);\nint hidden(void);\n",
    "c/calc.c": '#include "calc.h"\n\nint add(int a, int b) {\n    return a + b;\n}\nstatic int hidden(void) {\n    return 1;\n}\n',
    "rs/src/main.rs": "mod util;\nuse crate::util::{help as h, Tool};\nuse std::fs;\n\npub struct App {\n}\n\nimpl App {\n    fn go(&self) {\n        h();\n        util::help();\n        fs::read();\n    }\n}\n\nfn main() {\n    local();\n}\n\nfn local() {\n}\n",
    "rs/src/util.rs": "pub struct Tool {\n}\n\npub fn help() {\n}\n\nfn secret() {\n}\n",
    "cpp/geo.hpp": "namespace geo {\nint nsq(int x);\nstruct Disc {\n    double r;\n    int area();\n};\nnamespace inner {\nint deep(int x);\n}\n}\n",
    "cpp/geo.cpp": (
        '#include "bare.hpp"\n#include "geo.hpp"\n\nnamespace geo {\nint nsq(int x) {\n    return x * x;\n}\n\n'
        "int twice(int k) {\n    return nsq(k) + nsq(k);\n}\n}\n\nnamespace geo::inner {\nint deep(int x) {\n    return geo::nsq(x) + 1;\n}\n}\n\n"
        "double Circle::area() {\n    return nsq(2);\n}\n"
    ),
    "cpp/bare.hpp": "int nsq(int x);\n",
    "cpp/bare.cpp": '#include "bare.hpp"\n\nint nsq(int x) {\n    return x + 1;\n}\n',
    "cpp/use.cpp": '#include "geo.hpp"\nint use_geo() {\n    return geo::nsq(2);\n}\n\nint use_deep(Disc d) {\n    d.nsq(1);\n    return geo::inner::deep(3);\n}\n',
    "ws/crates/engine-core/Cargo.toml": '[workspace]\n\n[package]\nname = "engine-core"\n\n[dependencies]\nname = "no"\n',
    "ws/crates/engine-core/src/lib.rs": "pub mod run;\n\npub fn top() {\n}\n",
    "ws/crates/engine-core/src/run.rs": "pub fn go() {\n}\n",
    "ws/crates/engine-core/tests/it.rs": "use engine_core::run::go;\n\nfn checks() {\n    go();\n    engine_core::top();\n}\n",
    "ws/crates/toolbox/Cargo.toml": '[package]\nversion = "1"\nname = "ws-tools"\n',
    "ws/crates/toolbox/src/lib.rs": "pub fn helper() {\n}\n",
    "ws/vendor/toolbox/Cargo.toml": '[package]\nname = "ws-tools"\n',
    "ws/vendor/toolbox/src/lib.rs": "pub fn helper() {\n}\n",
    "ws/crates/cli/src/main.rs": "use ws_tools::helper;\nuse serde::Serialize;\n\nfn cli() {\n    helper();\n    fn nested() {\n        engine_core::run::go();\n    }\n}\n",
    "node_modules/x.ts": "export function no() {\n}\n",
    "notes.txt": "call main() here\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    nodes, edges = repository.scan(spark, str(root))
    return cut(nodes, "test-nodes"), cut(edges, "test-edges")


def pairs(edges, kind):
    return {(r.source.split(":", 1)[1], r.target.split(":", 1)[1]) for r in edges.where(f"kind = '{kind}'").collect()}


def test_files_and_symbols(tree):
    nodes = {r.node_id: r.summary for r in tree[0].collect()}
    assert "file:node_modules/x.ts" not in nodes and "file:notes.txt" in nodes
    for symbol in ("class:web/app.ts:Box", "function:web/app.ts:Box.open", "function:web/app.ts:arrow", "function:pkg/core.py:Job.act",
                   "function:pkg/core.py:broken", "class:store/store.go:DB", "function:store/store.go:DB.Close",
                   "function:c/main.c:twice", "function:rs/src/main.rs:App.go", "class:rs/src/util.rs:Tool",
                   "class:cpp/geo.hpp:geo::Disc", "function:cpp/geo.cpp:geo::inner::deep", "function:cpp/geo.cpp:Circle.area"):
        assert symbol in nodes
    assert nodes["file:cmd/help.go"] == "Go file, 4 lines: 1 function"
    assert nodes["function:web/greet.ts:greet"] == "Function greet, lines 1-2"


def test_imports(tree):
    assert pairs(tree[1], "imports") == {
        ("web/app.ts", "web/lib/index.ts"), ("web/app.ts", "web/util.ts"), ("web/lib/index.ts", "web/greet.ts"),
        ("pkg/core.py", "pkg/tools.py"), ("cmd/main.go", "store/store.go"),
        ("c/main.c", "c/calc.h"), ("c/calc.c", "c/calc.h"), ("rs/src/main.rs", "rs/src/util.rs"),
        ("cpp/geo.cpp", "cpp/bare.hpp"), ("cpp/geo.cpp", "cpp/geo.hpp"), ("cpp/bare.cpp", "cpp/bare.hpp"), ("cpp/use.cpp", "cpp/geo.hpp"),
        ("ws/crates/engine-core/src/lib.rs", "ws/crates/engine-core/src/run.rs"),
        ("ws/crates/engine-core/tests/it.rs", "ws/crates/engine-core/src/run.rs"), ("ws/crates/cli/src/main.rs", "ws/crates/toolbox/src/lib.rs"),
    }


def test_calls_and_decoys(tree):
    assert pairs(tree[1], "calls") == {
        ("web/app.ts:main", "web/greet.ts:greet"), ("web/app.ts:main", "web/util.ts:help"), ("web/app.ts:main", "web/app.ts:local"),
        ("web/app.ts:Box.open", "web/lib/index.ts:shout"), ("web/app.ts:arrow", "web/app.ts:main"),
        ("pkg/core.py:start", "pkg/tools.py:run"), ("pkg/core.py:Job.act", "pkg/core.py:start"), ("pkg/core.py:broken", "pkg/core.py:start"),
        ("cmd/main.go:main", "store/open.go:Open"), ("cmd/main.go:main", "cmd/help.go:helper"),
        ("c/main.c:twice", "c/calc.c:add"), ("c/main.c:main", "c/main.c:twice"),
        ("rs/src/main.rs:App.go", "rs/src/util.rs:help"), ("rs/src/main.rs:main", "rs/src/main.rs:local"),
        ("cpp/geo.cpp:geo::twice", "cpp/geo.cpp:geo::nsq"), ("cpp/geo.cpp:geo::inner::deep", "cpp/geo.cpp:geo::nsq"),
        ("cpp/geo.cpp:Circle.area", "cpp/bare.cpp:nsq"), ("cpp/use.cpp:use_geo", "cpp/geo.cpp:geo::nsq"),
        ("cpp/use.cpp:use_deep", "cpp/geo.cpp:geo::inner::deep"),
        ("ws/crates/engine-core/tests/it.rs:checks", "ws/crates/engine-core/src/run.rs:go"),
        ("ws/crates/engine-core/tests/it.rs:checks", "ws/crates/engine-core/src/lib.rs:top"),
        ("ws/crates/cli/src/main.rs:cli", "ws/crates/toolbox/src/lib.rs:helper"),
        ("ws/crates/cli/src/main.rs:nested", "ws/crates/engine-core/src/run.rs:go"),
    }


def test_exports(tree):
    assert {t for _, t in pairs(tree[1], "exports") if t.startswith(("pkg", "store"))} == {
        "pkg/core.py:start", "pkg/core.py:Job", "pkg/core.py:broken", "pkg/tools.py:run", "store/store.go:DB", "store/open.go:Open"}


def test_flows_start_where_nothing_calls(tree):
    roots = {r.path for r in semantics.entry_functions(*tree).collect() if not r.path.startswith(("cpp", "ws"))}
    assert roots == {"web/app.ts", "pkg/core.py", "cmd/main.go", "c/main.c", "rs/src/main.rs"}


def test_namespaces_do_not_change_linkage(tree):
    assert {t for _, t in pairs(tree[1], "exports") if t.startswith("cpp")} == {
        "cpp/geo.hpp:geo::Disc", "cpp/geo.cpp:geo::nsq", "cpp/geo.cpp:geo::twice", "cpp/geo.cpp:geo::inner::deep", "cpp/bare.cpp:nsq",
        "cpp/use.cpp:use_geo", "cpp/use.cpp:use_deep"}


def test_declarations_end_with_their_last_line(spark):
    text = "def a():\n    def b():\n        c()\n\n    b()\n\n\n# end\nclass K:\n    def m(self):\n        b()\n"
    facts = repository.facts(spark.createDataFrame([("x.py", text)], "path string, text string"))
    found = repository.symbols(facts)
    assert {(r.name, r.start_line, r.end_line) for r in found.collect()} == {("a", 1, 5), ("b", 2, 3), ("K", 9, 11), ("K.m", 10, 11)}
    called = repository.calls(facts, found)
    assert {(r.caller, r.callee) for r in called.collect()} == {("b", "c"), ("a", "b"), ("K.m", "b")}


def test_walk_shows_hidden_names_and_honours_ignore_files(spark, tmp_path):
    files = {
        ".gitignore": "# build output\nbuild/\n*.log\n!keep.log\n/top.txt\ndocs/**/draft.md\n[ab].tmp\n",
        "pkg/__init__.py": "", "pkg/_util.py": "def u():\n    pass\n", "pkg/m.py": "", "_private/z.py": "", ".github/ci.yml": "on: push\n",
        "build/gen.py": "", "pkg/build/more.py": "", "debug.log": "", "pkg/keep.log": "", "top.txt": "", "pkg/top.txt": "", "docs/a/b/draft.md": "",
        "docs/draft.md": "", "draft.md": "", "a.tmp": "", "c.tmp": "", "pkg/.gitignore": "m.py\n!/build/\n", "sub/m.py": "", "sub/.ignore": "*.md\n", "sub/x.md": "",
        "node_modules/x.js": "", "lib/target/y.rs": "", ".graphloom/map.json": "{}", "target.md": "a", "odd name é.txt": "é",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "raw.bin").write_bytes(b"ok \xff\xfe")
    (tmp_path / "link").symlink_to(tmp_path / "pkg")
    got = {r.path: r.text for r in repository.walk(spark, str(tmp_path)).collect()}
    want = {
        ".gitignore", "pkg/.gitignore", "pkg/__init__.py", "pkg/_util.py", "_private/z.py", ".github/ci.yml", "pkg/build/more.py", "pkg/keep.log",
        "pkg/top.txt", "draft.md", "c.tmp", "sub/m.py", "sub/.ignore", "target.md", "odd name é.txt", "raw.bin"}
    assert set(got) == want
    assert got["pkg/_util.py"] == files["pkg/_util.py"] and got["raw.bin"] == "ok ��"


def mapped(spark, tmp_path, files):
    for path, body in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    return cut(repository.scan(spark, str(tmp_path))[1], "test-edges")


def test_go_dot_imports_and_values_that_hide_packages(spark, tmp_path):
    edges = mapped(spark, tmp_path, {
        "go.mod": "module ex.org/m\n",
        "store/store.go": "package store\n\nfunc Open() {\n}\n\nfunc Close() {\n}\n\nfunc quiet() {\n}\n",
        "a/dot.go": 'package a\n\nimport . "ex.org/m/store"\n\nfunc Run() {\n\tOpen()\n\tquiet()\n}\n',
        "b/hide.go": (
            'package b\n\nimport "ex.org/m/store"\n\nfunc Param(store Thing) {\n\tstore.Open()\n}\n\nfunc Late() {\n\tstore.Open()\n\tx, store := two()\n\t_ = x\n}\n\n'
            "func Loop() {\n\tfor _, store := range all() {\n\t\tstore.Open()\n\t}\n}\n\nfunc Plain(n int) {\n\tstore.Close()\n}\n"),
    })
    assert pairs(edges, "calls") == {("a/dot.go:Run", "store/store.go:Open"), ("b/hide.go:Plain", "store/store.go:Close")}


def test_go_without_a_module_file(spark, tmp_path):
    edges = mapped(spark, tmp_path, {
        "lib/util/util.go": "package util\n\nfunc Help() {\n}\n", "x/same/s.go": "package same\n", "same/s.go": "package same\n",
        "cmd/main.go": 'package main\n\nimport (\n\t"old.org/me/lib/util"\n\t"other.org/x/same"\n\t"../same"\n\t"fmt"\n)\n\nfunc main() {\n\tutil.Help()\n}\n',
    })
    assert pairs(edges, "imports") == {("cmd/main.go", "lib/util/util.go"), ("cmd/main.go", "same/s.go")}
    assert pairs(edges, "calls") == {("cmd/main.go:main", "lib/util/util.go:Help")}


def test_rust_lists_within_lists(spark, tmp_path):
    assert sorted(repository.expand_use("use a::{b::{c, d as e}, f::{self, g::*}, h}")) == [
        ("a::b::c", "c"), ("a::b::d", "e"), ("a::f", "f"), ("a::h", "h")]
    assert repository.expand_use("mod util") == [("self::util", "util")] and repository.expand_use("use x as y") == [("x", "y")]
    edges = mapped(spark, tmp_path, {
        "src/lib.rs": "pub mod deep;\n\nuse crate::{\n    deep::{one::{first, second as other}, two},\n};\n\npub fn go() {\n    first();\n    other();\n    two::third();\n}\n",
        "src/deep/mod.rs": "pub mod one;\npub mod two;\n", "src/deep/one.rs": "pub fn first() {\n}\n\npub fn second() {\n}\n", "src/deep/two.rs": "pub fn third() {\n}\n",
    })
    assert pairs(edges, "calls") == {("src/lib.rs:go", "src/deep/one.rs:first"), ("src/lib.rs:go", "src/deep/one.rs:second"), ("src/lib.rs:go", "src/deep/two.rs:third")}
