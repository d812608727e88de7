"""Token classes of source texts."""

import pytest

from graphloom.sources import tokens
from test_statements import CASES, LANG


def shown(text, lang):
    return [(text[a:b], name) for a, b, name in tokens.tokens(text, lang)]


def test_classes_by_language():
    assert shown('@dec\ndef run(a: int) -> Box: # c\n    return Box(f"x{go(1)}", MAX, None).size', "python") == [
        ("@dec", "attribute"), ("def", "keyword"), ("run", "function"), ("(", "punctuation"), (":", "punctuation"), ("int", "type"), (")", "punctuation"), ("->", "operator"),
        ("Box", "type"), (":", "punctuation"), ("# c", "comment"), ("return", "keyword"), ("Box", "constructor"), ("(", "punctuation"), ('f"x{go(1)}"', "string"),
        (",", "punctuation"), ("MAX", "constant"), (",", "punctuation"), ("None", "constant"), (")", "punctuation"), (".", "punctuation"), ("size", "property")]
    ts = shown("const f = <T,>(a: T) => `x ${go(a)} y` + <div id='q'>{/re/g}</div> // end", "es")
    for want in (("const", "keyword"), ("go", "function"), ("`x ${", "string"), (" y`", "string"), ("div", "tag"), ("</", "punctuation"), ("'q'", "string"), ("/re/g", "string"), ("// end", "comment"), ("=>", "operator")):
        assert want in ts, want
    rust = shown("#[derive(Debug)]\npub fn go<'a>(x: &'a str) -> u8 { let c = 'x'; r#\"raw\"#; vec![0x1F_u8, 1.5e3] }", "rust")
    for want in (("#[derive(Debug)]", "attribute"), ("'a", "label"), ("'x'", "string"), ('r#"raw"#', "string"), ("0x1F_u8", "number"), ("1.5e3", "number"), ("str", "type")):
        assert want in rust, want
    c = shown("#include <a.h>\nint main(void) { p->x = NULL; return g('c'); }", "c")
    for want in (("#include <a.h>", "keyword"), ("main", "function"), ("void", "type"), ("NULL", "constant"), ("'c'", "string"), ("->", "operator")):
        assert want in c, want
    go = shown("func (s *Store) Open() error { return nil }", "go")
    assert ("Store", "type") in go and ("error", "type") in go and ("nil", "constant") in go and ("Open", "function") in go


@pytest.mark.parametrize("path", CASES)
def test_tokens_are_in_order_and_leave_out_white_space_only(path):
    text, lang = CASES[path][0], LANG[path.split(".")[1]]
    for part in (text, text[:301], text[37:]):
        found = tokens.tokens(part, lang)
        assert all(a < b <= c for (a, b, _), (c, _, _) in zip(found, found[1:])) and {name for _, _, name in found} <= set(tokens.CLASSES)
        covered = set().union(*(range(a, b) for a, b, _ in found))
        left = "".join(c for i, c in enumerate(part) if i not in covered)
        assert all(c.isspace() or c.isidentifier() or c.isdigit() or c in "\"'`" for c in left), left


def test_rows(spark):
    files = spark.createDataFrame([("a.py", "x = 1\n"), ("b.txt", "def x(): 1"), ("c.py", None), ("d.go", "")], "path string, text string")
    assert sorted(map(tuple, tokens.token_rows(files).collect())) == [("a.py", 2, 3, "operator"), ("a.py", 4, 5, "number")]
