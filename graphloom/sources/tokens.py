"""The tokens of source texts as rows, each with one of 14 classes; no markup.

Comments, strings, directives and attributes come from the lexer of ``statements``, code within
template strings included; what is left is cut by longest match, and a name gets its class from its
spelling and from the signs around it. A file of a language without a lexer has no rows, which is
plain text. Tokens don't overlap and are in order; white space is in none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.repository import language
from graphloom.sources.statements import blanked

#: The classes.
CLASSES = ("attribute", "comment", "constant", "constructor", "function", "keyword", "label", "number", "operator", "property", "punctuation", "string", "tag", "type")
#: By language, words of its grammar.
KEYWORDS = {
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try while with yield",
    "es": "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in instanceof interface "
          "let namespace new of private protected public readonly return set static super switch throw try type typeof var void while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type union unsafe use where while",
    "c": "auto break case catch class const constexpr continue default delete do else enum explicit extern final for friend goto if inline namespace new noexcept operator override private protected public register "
         "return sizeof static struct switch template throw try typedef typename union using virtual volatile while",
}
KEYWORDS = {lang: frozenset(words.split()) for lang, words in KEYWORDS.items()}
#: Words that are values, and names of types that aren't capital.
VALUES = frozenset("true false null undefined None True False nil NULL nullptr this NaN Infinity iota".split())
TYPES = frozenset(
    "any bool boolean byte char double error float float32 float64 f32 f64 i8 i16 i32 i64 i128 int int8 int16 int32 int64 isize long never number object rune "
    "short signed size_t str string symbol u8 u16 u32 u64 u128 uint uint8 uint16 uint32 uint64 unknown unsigned usize void".split())
_TOKEN = re.compile(
    r"(?P<number>(?<![\w.])(?:0[xX][\da-fA-F_']+|0[bB][01_']+|0[oO][0-7_]+|\d[\d_']*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+)\w*)"
    r"|(?P<attribute>(?<![\w)\]])@[A-Za-z_][\w.]*)|(?P<label>'[A-Za-z_]\w*)|(?P<tag>(?:(?<=[\s({>=]<)|(?<=</))[A-Za-z][\w.\-]*(?=[\s/>]))|(?P<name>[^\W\d]\w*)"
    r"|(?P<punctuation>::|[()\[\]{},;.:]|</?(?=[A-Za-z]))|(?P<operator>[+\-*/%=<>!&|^~?@$\\#]+)")
_AFTER = re.compile(r"\s*(?:!\s*)?(?:::)?(?:<[^<>()]*>)?\s*\(")


def _named(word: str, code: str, start: int, end: int, lang: str) -> str:
    """The class of a name by its spelling and what stands around it."""
    if word in KEYWORDS[lang]:
        return "keyword"
    if word in VALUES:
        return "constant"
    member = code[:start].rstrip()[-1:] == "." if start and code[start - 1] in ". \n\t" else False
    called = _AFTER.match(code, end) is not None
    if called:
        return "constructor" if word[0].isupper() and lang in ("python", "es", "rust") else "function"
    if len(word) > 1 and word.isupper():
        return "constant"
    if word in TYPES or (word[0].isupper() and not member):
        return "type"
    return "property" if member else ""


def tokens(text: str, lang: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the tokens of a text, in order, none within another."""
    marks: list[tuple[int, int, str]] = []
    bare, _ = blanked(text, lang, marks)
    out, at = [], 0
    for begin, end, name in [*sorted(marks), (len(text), len(text), "")]:
        for m in _TOKEN.finditer(bare, at, begin):
            kind = m.lastgroup
            if kind == "tag" and lang != "es" or kind == "label" and lang != "rust":
                kind = "name"
            if kind == "name":
                kind = _named(m[0].lstrip("'"), bare, m.start(), m.end(), lang)
            if kind:
                out.append((m.start(), m.end(), kind))
        if name:
            out.append((begin, end, name))
        at = end
    return out


def token_rows(files: DataFrame) -> DataFrame:
    """(path, start, end, class) of the tokens of ``files`` (path, text); places are of characters."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text"))):
                found = tokens(text or "", lang)
                columns = zip(*found) if found else ((), (), ())
                starts, ends, names = (list(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(names, pa.string())],
                                                 names=["path", "start", "end", "class"])

    known = files.select("path", language(F.col("path")).alias("lang"), "text").where("lang IS NOT NULL")
    return known.mapInArrow(read, "path string, start int, end int, class string")
