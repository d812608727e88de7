"""The lexer and the pushdown over brackets, on forms that formatters and people write."""

import pytest

from graphloom.session import cut
from graphloom.sources import repository
from graphloom.sources.statements import blanked, statements

PYTHON = '''def long_head(
    a,
    b={"k": 1},
) -> dict[
    str, int
]:
    """def ghost():
    inner()
text at the margin
    """
    s = """
margin
"""
    return run(a) and f"{call(b)!r:>{wide()}} {{no()}}" + g(
        'it"s',
    )


class K(Base):
    # def ghost(): no()
    @dec(1)
    async def m(self): return z()

    if True:
        def n(self): pass


if x:
    def inside(): return "\\"" + after()
'''
TYPESCRIPT = '''/* function ghost() {
  no() } */
export function run<T extends { a: string }, U = () => void>(
  x: T,
): { n: number } {
  const t = `function ghost() { ${call(`in ${deep({ a: 1 })}`)} }`;
  return other<T>({ a: 1, b: [2] });
}
export const App = ({ a, b }: Props) => {
  useEffect(() => { tick(); }, [a]);
  return /['"`{]/.test(a) ? <p>Don't</p> : null
}
const short = (x: number): number => help(x)
const curried = (a) => wrap((b) => {
  inner(b);
});
class Box<T> extends Base<T> {
  handle = async (e: Event): Promise<void> => {
    work(e)
  }
  private count = 0
  async method(
    a: number,
    { b }: { b: string } = {},
  ): Promise<void> {
    a / b; go(a) / 2; new Thing(a); this.x().chained(); q?.opt()
  }
  abstract sign(a: number): void
}
const api = { get() { fetchIt() }, post: () => { send() } }
const fn = async function named() { fnBody() }
export function
spread(a) {
  return a
}
'''
GO = '''package a

type (
\tA struct {
\t\tx int
\t}
\tB struct{ y string }
)

var q = `
func ghost() {
}
`
var z = "x"

func (s *A) Long(
\ta int,
\tb func(x int) error,
) (int, error) {
\tm := map[string]int{"a": f()}
\tgo func() {
\t\tg('{')
\t}()
\tfor i := range xs { h(i) }
\tif v, ok := m["a"]; ok {
\t\treturn T{1}.x(), nil
\t}
\treturn 0, nil
}

func Gen[T any](a T) {}
'''
RUST = '''/* a /* fn ghost() {} */ fn ghost() {} */
#[derive(Debug, serde(tag = "]"))]
pub struct P<'a, T> { x: &'a T }
pub struct U;
impl<'a, T: Into<Vec<u8>>> Tr<T> for P<'a, T>
where
    T: X,
{
    pub fn long(
        &self,
        a: &'a str,
    ) -> u8
    where
        T: Y,
    {
        let s = r#"fn ghost() { "x" }"#;
        let c = '{';
        match a { "x" => f(), _ => { g() } }
    }
    fn sig(&self);
}
mod tests {
    pub fn inner() { a::b::c(); v.method(); vec![1] }
}
'''
CPP = '''#define X(a) \\
  int ghost(int a) { return foo(a); }
/* int ghost() {
} */
namespace geo {
static int lng(
  int a,
  int b)
{
    return add(a, b);
}
template <typename T, int N>
class Disc final : public Base<T> {
public:
  explicit Disc(int r) : r_(r) { init(); }
  int area() const noexcept { return sq(1'000, '{'); }
  void decl(int a);
};
}
typedef struct { int a; struct { int b; } c; } frame;
double Circle::area() const { return nsq(2); }
Circle::Circle() {}
const char* s = R"x(int ghost() { })x";
std::map<int, std::string> build(int k) { for (;;) { step(k); if (k) { k--; } } }
#ifdef __cplusplus
extern "C" {
#endif
int cfun(void) { return 1; }
#ifdef __cplusplus
}
#endif
'''
#: By file: (name, its first and last line, owner or receiver), and words that are called in the functions.
CASES = {
    "a.py": (PYTHON, [("long_head", 1, 16, None), ("K", 19, 25, None), ("m", 22, 22, "K"), ("n", 25, 25, "K"), ("inside", 29, 29, None)]),
    "a.ts": (TYPESCRIPT, [
        ("run", 3, 8, None), ("App", 9, 12, None), ("short", 13, 13, None), ("curried", 14, 16, None), ("Box", 17, 29, None), ("handle", 18, 20, "Box"),
        ("method", 22, 27, "Box"), ("get", 30, 30, None), ("fn", 31, 31, None), ("spread", 32, 35, None)]),
    "a.go": (GO, [("A", 4, 6, None), ("B", 7, 7, None), ("Long", 16, 29, "A"), ("Gen", 31, 31, None)]),
    "a.rs": (RUST, [("P", 3, 3, None), ("U", 4, 4, None), ("P", 5, 21, None), ("long", 9, 19, "P"), ("inner", 23, 23, None)]),
    "a.cpp": (CPP, [
        ("geo", 5, 19, None), ("lng", 6, 11, None), ("Disc", 13, 18, None), ("Disc", 15, 15, "Disc"), ("area", 16, 16, "Disc"), ("frame", 20, 20, None),
        ("Circle::area", 21, 21, None), ("Circle::Circle", 22, 22, None), ("build", 24, 24, None), ("cfun", 28, 28, None)]),
}
LANG = {"py": "python", "ts": "es", "go": "go", "rs": "rust", "cpp": "c"}


@pytest.mark.parametrize("path", CASES)
def test_heads_ends_and_owners(path):
    text, want = CASES[path]
    rows, _ = statements(path, text, LANG[path.split(".")[1]])
    got = [(r.name, r.line, r.end_line, r.of or r.owner if r.kind == "function" else None) for r in rows if r.kind]
    assert got == want
    assert not any(r.name == "ghost" for r in rows)


def test_calls_of_all_languages(spark):
    facts = repository.facts(spark.createDataFrame([(p, t) for p, (t, _) in CASES.items()], "path string, text string"))
    facts = cut(facts, "test-facts")
    found = repository.symbols(facts)
    called = {(r.path, r.caller, r.receiver, r.callee) for r in repository.calls(facts, found).collect()}
    assert called == {
        ("a.py", "long_head", "", "run"), ("a.py", "long_head", "", "call"), ("a.py", "long_head", "", "wide"), ("a.py", "long_head", "", "g"), ("a.py", "K.m", "", "z"), ("a.py", "inside", "", "after"),
        ("a.ts", "run", "", "call"), ("a.ts", "run", "", "deep"), ("a.ts", "run", "", "other"), ("a.ts", "App", "", "useEffect"), ("a.ts", "App", "", "tick"),
        ("a.ts", "short", "", "help"), ("a.ts", "curried", "", "wrap"), ("a.ts", "curried", "", "inner"), ("a.ts", "Box.handle", "", "work"),
        ("a.ts", "Box.method", "", "go"), ("a.ts", "Box.method", "this", "x"), ("a.ts", "get", "", "fetchIt"), ("a.ts", "fn", "", "fnBody"),
        ("a.go", "A.Long", "", "f"), ("a.go", "A.Long", "", "g"), ("a.go", "A.Long", "", "h"),
        ("a.rs", "P.long", "", "f"), ("a.rs", "P.long", "", "g"), ("a.rs", "inner", "a.b", "c"),
        ("a.cpp", "geo::lng", "", "add"), ("a.cpp", "geo::Disc.Disc", "", "init"), ("a.cpp", "geo::Disc.Disc", "", "r_"), ("a.cpp", "geo::Disc.area", "", "sq"),
        ("a.cpp", "Circle.area", "", "nsq"), ("a.cpp", "build", "", "step"),
    }
    exported = {(r.path, r.name) for r in found.where("exported").collect()}
    assert exported == {
        ("a.py", "long_head"), ("a.py", "K"), ("a.py", "inside"), ("a.ts", "run"), ("a.ts", "App"), ("a.ts", "spread"), ("a.go", "A"), ("a.go", "B"), ("a.go", "Gen"),
        ("a.rs", "P"), ("a.rs", "U"), ("a.rs", "inner"), ("a.cpp", "geo::Disc"), ("a.cpp", "frame"), ("a.cpp", "build"), ("a.cpp", "cfun")}


@pytest.mark.parametrize("path", CASES)
def test_blanks_keep_every_place_and_broken_files_end(path):
    text, lang = CASES[path][0], LANG[path.split(".")[1]]
    for cut_at in range(0, len(text), 7):
        part = text[:cut_at] + text[cut_at + 11 :]
        bare, code = blanked(part, lang)
        assert len(bare) == len(code) == len(part) and code.count("\n") == part.count("\n")
        rows, _ = statements(path, part, lang)
        assert all(r.line <= r.end_line <= part.count("\n") + 1 for r in rows if r.kind)


def test_imports_are_not_read_in_comments_and_texts(spark):
    files = spark.createDataFrame([
        ("a.py", '"""\nfrom pkg import no\n"""\n# import no\nfrom pkg import (\n    yes as y,\n)\n'),
        ("a.ts", "/*\nimport { no } from './no';\n*/\nconst t = `\nimport { no } from './no';\n`;\nimport { yes as y } from './yes';\n"),
        ("a.go", 'package a\n\n/*\nimport "no"\n*/\nvar t = `\nimport "no"\n`\n\nimport (\n\t"yes"\n)\n'),
        ("a.rs", "/* use no::no; */\nuse yes::yes;\n"), ("a.c", '/*\n#include "no.h"\n*/\n#include "yes.h"\n'),
    ], "path string, text string")
    code = repository.facts(files).where("kind = 'code'").select("path", "text")
    got = {(r.path, r.specifier) for r in repository.imports(code).collect()}
    assert got == {("a.py", "pkg"), ("a.ts", "./yes"), ("a.go", "yes"), ("a.rs", "yes::yes"), ("a.c", "yes.h")}


def test_a_scan_finds_calls_of_functions_with_long_heads(spark, tmp_path):
    files = {
        "pkg/a.py": "from pkg.b import target\n\ndef caller(\n    a,\n    b,\n):\n    '''\n    def ghost():\n        target()\n    '''\n    return target(\n        a,\n    )\n",
        "pkg/b.py": "def target(\n    a,\n):\n    return a\n", "go.mod": "module ex.org/m\n", "g/a.go": "package g\n\nfunc Caller(\n\ta int,\n) int {\n\treturn Target(\n\t\ta,\n\t)\n}\n",
        "g/b.go": "package g\n\nfunc Target(a int) int {\n\treturn a\n}\n", "r/src/lib.rs": "pub fn caller(\n    a: u8,\n) -> u8\nwhere\n    u8: Copy,\n{\n    target(\n        a,\n    )\n}\n\nfn target(a: u8) -> u8 {\n    a\n}\n",
        "c/a.c": "int target(\n  int a)\n{\n  return a;\n}\n/* int ghost() {\n  target(1);\n} */\nint caller(\n  int a)\n{\n  return target(\n    a);\n}\n",
        "w/a.ts": "import { target } from './b';\nexport function caller<T>(\n  a: T,\n): T {\n  return target(\n    a,\n  );\n}\n", "w/b.ts": "export const target = (\n  a: any,\n) => {\n  return a;\n};\n",
    }
    for path, body in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    nodes, edges = repository.scan(spark, str(tmp_path))
    said = {r.summary for r in nodes.where("kind = 'function' AND name = 'caller'").collect()}
    assert said == {"Function caller, lines 3-13", "Function caller, lines 1-10", "Function caller, lines 9-14", "Function caller, lines 2-8"}
    calls = {(r.source.split(":", 1)[1], r.target.split(":", 1)[1]) for r in edges.where("kind = 'calls'").collect()}
    assert calls == {
        ("pkg/a.py:caller", "pkg/b.py:target"), ("g/a.go:Caller", "g/b.go:Target"), ("r/src/lib.rs:caller", "r/src/lib.rs:target"),
        ("c/a.c:caller", "c/a.c:target"), ("w/a.ts:caller", "w/b.ts:target")}
