"""Source text as statements: a lexer for each language and a pushdown over brackets.

``blanked`` empties comments and strings, whatever lines they span, and leaves the code
that template and format strings hold. ``statements`` goes once over what is left
with a stack of open brackets: in Python a statement is a logical line and blocks are
told by indentation; elsewhere it ends with its body's brace, a semicolon or, where
the language has it so, a line that can't go on. Each statement is a row that knows
its declaration, where that ends, what holds it and the function around it; what it says is
for Spark's expressions to read. A broken file loses a bracket's scope at most.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Words before a bracket that are no calls and no names of functions.
KEYWORDS = frozenset((
    "if elif else for while switch case return func function def class with catch except lambda await typeof new in not and or "
    "print range len super constructor make append panic string int import export assert del yield raise async"
).split())

# --- lexer ------------------------------------------------------------------------

_SLASHES = r"(?P<comment>//[^\n]*)|(?P<block>/\*)"
_STARTS = {
    "python": r"(?P<comment>\#[^\n]*)|(?P<long>\b[rRbBuUfF]{0,2}\"\"\"|\b[rRbBuUfF]{0,2}'''|\"\"\"|''')|(?P<short>\b[rRbBuUfF]{1,2}[\"']|[\"'])",
    "es": _SLASHES + r"|(?P<short>[\"'])|(?P<template>`)|(?P<brace>[{}])|(?P<regex>/)",
    "go": _SLASHES + r"|(?P<short>[\"'])|(?P<raw>`)",
    "rust": _SLASHES + r"|(?P<rawhash>\b(?:b|c|br|cr)?r\#*\")|(?P<short>\b[bc]?\"|\")|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])')|(?P<attribute>\#!?\[)",
    "c": _SLASHES + r"|(?P<directive>^[ \t]*\#(?:\\\r?\n|[^\n])*)|(?P<rawparen>\b(?:u8|[uUL])?R\"(?P<mark>[^(\s\\]{0,16})\()|(?P<short>\"|(?<!\d)')",
}
_STARTS = {lang: re.compile(pattern, re.M) for lang, pattern in _STARTS.items()}
_SHORT = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\(?:\r?\n|.))*{q}", re.S) for q in "\"'"}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(\[{,;=:!&|?+\-*%~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new))\s*$")
_NOT_BREAK = re.compile(r"[^\n]")
_IN_ATTRIBUTE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|[\[\]]", re.S)
_BRACES = re.compile(r"\{\{|\}\}|[{}]")


def _empty(text: str) -> str:
    """Blanks of the same length and lines."""
    return _NOT_BREAK.sub(" ", text)


def _string(length: int) -> str:
    """An empty string of that length, on one line."""
    return '"' + " " * (length - 2) + '"' if length > 1 else " " * length


def _fields(text: str) -> str:
    """A format string of which only the code within braces is left, in parentheses."""
    out, at, depth = [], 0, 0
    for m in _BRACES.finditer(text):
        if not depth and m[0] == "{" or depth and m[0][0] == "{":
            out += [" " * (m.start() - at) if not depth else text[at : m.start()], "(" * len(m[0])]
            depth, at = depth + len(m[0]), m.end()
        elif depth and m[0][0] == "}":
            out += [text[at : m.start()], ")" * min(len(m[0]), depth), " " * (len(m[0]) - depth)]
            depth, at = max(0, depth - len(m[0])), m.end()
    out.append(" " * (len(text) - at))
    code = blanked("".join(out)[1:-1], "python")[0]
    return '"' + code.replace("\n", " ") + '"'


def blanked(text: str, lang: str, marks: list[tuple[int, int, str]] | None = None) -> tuple[str, str]:
    """(code without comments and with empty strings, each on one line; code without
    comments and strings of several lines, with its lines as they are). Both are as long as ``text``.
    ``marks`` gets (start, end, class) of each comment, string, directive and attribute."""
    start = _STARTS[lang]
    bare, code = [], []
    at, open_braces = 0, []  # of the template strings that are open: braces within their code
    kind = ""

    def mark(end: int, name: str) -> None:
        if marks is not None and end > at:
            marks.append((at, end, name))

    def keep(end: int) -> None:
        nonlocal at
        bare.append(text[at:end])
        code.append(text[at:end])
        at = end

    def drop(end: int) -> None:
        """A comment goes."""
        nonlocal at
        mark(end, "attribute" if kind == "attribute" else "comment")
        bare.append(_empty(text[at:end]))
        code.append(bare[-1])
        at = end

    def string(end: int, said: str | None = None) -> None:
        """A string is emptied, but for code in it; the second result keeps one that is on one line."""
        nonlocal at
        mark(end, "string")
        bare.append(_string(end - at) if said is None else said)
        code.append(_empty(text[at:end]) if "\n" in text[at:end] or lang == "rust" else text[at:end])
        at = end

    def template(begin: int) -> None:
        """From a template's start, or the end of code in it, to its end or the next code."""
        nonlocal at
        i = begin
        while i < len(text) and text[i] != "`" and not text.startswith("${", i):
            i += 2 if text[i] == "\\" else 1
        i = min(i, len(text))
        if text.startswith("${", i):
            string(i + 2, _string(i + 1 - at) + "(")
            open_braces.append(0)
        else:
            string(min(i + 1, len(text)))

    while True:
        m = start.search(text, at)
        if m is None:
            keep(len(text))
            return "".join(bare), "".join(code)
        kind, begin = m.lastgroup if m.lastgroup != "mark" else "rawparen", m.start()
        if kind == "brace":
            keep(begin + 1)
            if open_braces and text[begin] == "{":
                open_braces[-1] += 1
            elif open_braces and open_braces[-1]:
                open_braces[-1] -= 1
            elif open_braces:
                open_braces.pop()
                bare[-1] = code[-1] = bare[-1][:-1] + ")"
                template(at)
            continue
        keep(begin)
        if kind == "comment":
            drop(m.end())
        elif kind == "block":
            depth, i = 1, begin + 2
            while depth:
                step = re.compile(r"\*/|/\*" if lang == "rust" else r"\*/").search(text, i)
                if step is None:
                    i = len(text)
                    break
                depth += 1 if step[0] == "/*" else -1
                i = step.end()
            drop(i)
        elif kind == "short":
            body = _SHORT[m[0][-1]].match(text, m.end() - 1)
            if body is None:  # no string, or one that is never closed
                keep(m.end())
            else:
                formats = lang == "python" and "f" in m[0].lower() and "{" in body[0]
                string(body.end(), _fields(text[begin : body.end()]) if formats else None)
        elif kind == "long":
            end = text.find(m[0][-3:], m.end())
            end = len(text) if end < 0 else end + 3
            string(end, _fields(text[begin:end]) if "f" in m[0].lower() else None)
        elif kind == "template":
            template(begin + 1)
        elif kind == "raw":
            end = text.find("`", begin + 1)
            string(len(text) if end < 0 else end + 1)
        elif kind == "rawhash":
            close = '"' + "#" * m[0].count("#")
            end = text.find(close, m.end())
            string(len(text) if end < 0 else end + len(close))
        elif kind == "rawparen":
            close = f"){m['mark']}\""
            end = text.find(close, m.end())
            string(len(text) if end < 0 else end + len(close))
        elif kind == "char":
            string(m.end())
        elif kind == "directive":
            mark(m.end(), "keyword")
            bare.append(_empty(m[0]))
            code.append(m[0])
            at = m.end()
        elif kind == "attribute":
            depth, i = 1, m.end()
            while depth and (step := _IN_ATTRIBUTE.search(text, i)):
                depth += (step[0] == "[") - (step[0] == "]")
                i = step.end()
            drop(i if not depth else m.end())
        else:  # a slash: a regular expression or a division
            body = _REGEX.match(text, begin) if _BEFORE_REGEX.search("".join(bare[-4:])[-40:]) else None
            if body is None:
                keep(begin + 1)
            else:
                string(body.end())


# --- declarations -----------------------------------------------------------------

_MODIFIERS = r"(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract|declare|accessor)\s+)*"
_EXPORT = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_TYPED = r"(?:template\s+)?(?:[A-Za-z_][\w:,]*[\s*&]+)+"
#: By language: (kind, pattern over a statement whose generics are gone, group of the name, group of a receiver type or 0).
DECLARATIONS = {
    "python": [("function", r"(?:async\s+)?def\s+(\w+)", 1, 0), ("class", r"class\s+(\w+)", 1, 0)],
    "es": [
        ("function", rf"{_EXPORT}(?:async\s+)?function\s*\*?\s*(\w+)", 1, 0),
        ("value", rf"{_EXPORT}(?:const|let|var)\s+(\w+)\b[^=]*=\s*(?:async\s+)?function\b", 1, 0),
        ("arrow", rf"{_EXPORT}(?:const|let|var)\s+(\w+)\b", 1, 0),
        ("class", rf"{_EXPORT}(?:abstract\s+)?class\s+(?!extends\b)(\w+)", 1, 0),
        ("field", rf"{_MODIFIERS}#?(\w+)\s*[?!]?\s*(?::.*)?=", 1, 0),
        ("method", rf"{_MODIFIERS}\*?\s*#?(\w+)\s*\??\(", 1, 0),
    ],
    "rust": [
        ("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern(?:\s*\"\s*\")?)\s+)*fn\s+(\w+)", 1, 0),
        ("class", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", 1, 0),
        ("scope", r"(?:default\s+)?(?:unsafe\s+)?impl\b\s*!?(?:.*?\sfor\s+)?[&\s]*(?:mut\s+|dyn\s+)*(?:\w+::)*(\w+)", 1, 0),
        ("scope", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", 1, 0),
    ],
    "c": [
        ("namespace", r"(?:inline\s+)?namespace\s+([\w:]+)$", 1, 0),
        ("class", r"(?:template\s+)?(?:typedef\s+)?(?:struct|class)\s+(?:\w+\s*\([^)]*\)\s*)?(\w+)\s*(?:final\s*)?(?::(?!:).*)?$", 1, 0),
        ("nameless", r"typedef\s+(struct)$", 1, 0),
        ("function", rf"{_TYPED}((?:\w+::)*~?\w+)\s*\(", 1, 0),
        ("function", r"((?:\w+::)+~?\w+)\s*\(", 1, 0),
        ("method", r"(?:(?:explicit|virtual|inline|constexpr)\s+)*(~?\w+)\s*\(", 1, 0),
    ],
    "go": [
        ("function", r"func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*[(\[]", 2, 1),
        ("class", r"(?:type\s+(?:\(\s*)?)?(\w+)(?:\s*\[[^\]]*\])?\s+struct$", 1, 0),
    ],
}
DECLARATIONS = {lang: [(kind, re.compile(pattern, re.S), name, of) for kind, pattern, name, of in rules] for lang, rules in DECLARATIONS.items()}
#: What may stand before a declaration: access labels and decorators.
_LABELS = re.compile(r"(?:(?:public|private|protected)\s*:(?!:)\s*|@[\w.]+(?:\([^()]*\))?\s+)+")
#: What stands before a declaration in its statement and is no part of it.
_LEAD = re.compile(r"(?:(?:(?:public|private|protected)\s*:(?!:)|@[\w.]+(?:\([^()]*\))?|export\b|default\b|declare\b|type\s*\(|template\s*<[^{}()]*?>(?=\s))\s*)+")
_PROTOTYPE = re.compile(r"(?:extern\s+)?(?:[A-Za-z_][\w:]*[\s*&]+)+(\w+)\s*\([^;{}()]*\)$")
_NO_PROTOTYPE = re.compile(r"(?:return|typedef|static|else|new|delete|throw|using)\b")
_GENERICS = re.compile(r"<[^<>()]*>")
_HEADER = re.compile(r"\.(?:h|hpp|hh|hxx)$")


def _plain(text: str) -> str:
    """A statement on one line, without labels, decorators and generics."""
    text = " ".join(text.split()).replace("=>", "⇒").replace("->", "→")
    before = None
    while before != text and "<" in text:
        before, text = text, _GENERICS.sub("", text)
    return _LABELS.sub("", text, count=1) if text[:1] in "pP@" else text


@dataclass
class Statement:
    """A row: text, the declaration it makes and what is around it."""

    seq: int
    line: int
    text: str
    end_line: int = 0
    kind: str | None = None
    name: str | None = None
    of: str | None = None
    owner: str | None = None
    space: str = ""
    outer: bool = True
    function_seq: int | None = None


@dataclass
class _Level:
    """An open block: the declaration whose body it is, brackets open in the statement at hand, and where that began."""

    decl: Statement | None
    start: int
    own: bool = True
    brackets: list[list] = field(default_factory=list)  # [bracket, start of a literal's present item]
    going: Statement | None = None  # a function without braces that lasts as long as its statement
    arrow: bool = False


class _Reader:
    def __init__(self, path: str, text: str, bare: str, lang: str):
        self.path, self.bare, self.lang = path, bare, lang
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.rows: list[Statement] = []
        self.levels = [_Level(None, 0)]

    def line_at(self, place: int) -> int:
        return bisect_right(self.breaks, place - 1) + 1

    def holders(self) -> Iterator[Statement]:
        """Open declarations, the innermost first."""
        for level in reversed(self.levels):
            for decl in (level.going, level.decl):
                if decl is not None:
                    yield decl

    def declaration(self, text: str, opens: bool, arrow: bool) -> tuple[str, str, str | None] | None:
        """(kind, name, receiver) of what a statement declares."""
        held = next(self.holders(), None)
        plain = _plain(text)
        for kind, pattern, group, of in DECLARATIONS[self.lang]:
            m = pattern.match(plain)
            if m is None or m[group] in KEYWORDS and kind not in ("class", "scope"):
                continue
            receiver = m[of] if of else None
            if kind == "arrow" or kind == "field":
                if not arrow or (kind == "field" and (held is None or held.kind != "class")):
                    continue
                return "function", m[group], receiver
            if kind == "value" or (self.lang == "python"):
                return "function" if kind == "value" else kind, m[group], receiver
            if self.lang == "rust" and kind == "class":
                return kind, m[group], receiver
            if not opens:
                continue
            if self.lang == "c" and kind in ("function", "method") and held is not None and held.kind == "function":
                continue
            if self.lang == "c" and kind == "method" and (held is None or held.kind != "class"):
                continue
            if self.lang == "go" and kind == "class" and held is not None:
                continue
            return "function" if kind == "method" else kind, m[group], receiver
        if self.lang == "c" and not opens and held_outside(held) and _HEADER.search(self.path) and not _NO_PROTOTYPE.match(plain) and (m := _PROTOTYPE.match(plain)):
            return "prototype", m[1], None
        return None

    def add(self, begin: int, end: int, declares: str | None, opens: bool = False, arrow: bool = False) -> Statement | None:
        """The statement between two places; ``declares`` is the text to read a declaration from."""
        text = self.bare[begin:end]
        if not text.strip():
            return None
        place = begin + len(text) - len(text.lstrip())
        found = self.declaration(declares, opens, arrow) if declares is not None else None
        if found and declares is not text:
            place = end - len(declares.lstrip())
        row = Statement(place, self.line_at(place), " ".join(text.split()), self.line_at(max(begin, begin + len(text.rstrip()) - 1)))
        holders = list(self.holders())
        row.owner = next((h.name for h in holders if h.kind in ("class", "scope")), None)
        spaces = [h.name for h in reversed(holders) if h.kind == "namespace"]
        row.space, row.outer = "::".join(spaces), all(h.kind == "namespace" for h in holders)
        row.function_seq = next((h.seq for h in holders if h.kind == "function"), None)
        if found:
            row.kind, row.name, row.of = found
            lead = _LEAD.match(self.bare, place, end)
            row.line = self.line_at(lead.end() if lead else place)
            if row.kind == "function":
                row.function_seq = row.seq
                # A declared name is no call.
                row.text = re.sub(rf"(?<!\w){re.escape(row.name)}(?=\s*[(<\[])", "~", row.text, count=1) if not arrow else row.text
        self.rows.append(row)
        return row if found else None


def held_outside(held: Statement | None) -> bool:
    return held is None or held.kind == "namespace"


# --- pushdown over brackets -------------------------------------------------------

_TOKEN = {
    "python": re.compile(r"[()\[\]{}\n]"),
    "es": re.compile(r"[()\[\]{};,\n]|=>"), "go": re.compile(r"[()\[\]{};\n]"), "rust": re.compile(r"[()\[\]{};]"), "c": re.compile(r"[()\[\]{};]"),
}
_PAIR = {")": "(", "]": "[", "}": "{"}
_LITERAL_BEFORE = {"es": "(,=[:?&|", "go": "(,=[:", "rust": ":", "c": "=,("}
_LITERAL_WORDS = re.compile(
    r"\b(?:return|extends|default|typeof|in|of|case|throw|new|as|satisfies|yield|await|import|export|type|const|let|var)$")
_GOES_ON = {"es": re.compile(r"[(\[{,;=+\-*/%&|^!~?:<.⇒]$|=>$|\b(?:extends|implements|const|let|var|export|default|import|from|as|typeof|new|in|of|instanceof|async|function|class)$"),
            "go": re.compile(r"[(\[{,=+\-*/%&|^<>!:.]$")}
_FOLLOWS = {"es": re.compile(r"\s*(?:[{.?:=|&+*,)\]%^<>\-]|(?:extends|implements|from|as|satisfies|instanceof|in|of)\b)"), "go": re.compile(r"\s*[)\]]")}


def _is_literal(bare: str, place: int, lang: str) -> bool:
    """Whether the brace at ``place`` opens a value, a type or a list of names and no block."""
    head = bare[max(0, place - 80) : place].rstrip()
    if not head:
        return False
    if lang == "go" and (head[-1].isalnum() or head[-1] in "_]}") and bare[place - 1] == head[-1]:
        return not re.search(r"\b(?:else|for|select|switch|struct|interface|func)$", head)
    if head[-1] in _LITERAL_BEFORE[lang]:
        return True
    return (lang == "es" and _LITERAL_WORDS.search(head) is not None) or (lang == "c" and re.search(r"\breturn$", head) is not None)


def _braced(reader: _Reader) -> None:
    bare, lang, levels = reader.bare, reader.lang, reader.levels

    def finish(level: _Level, place: int) -> None:
        """The statement at hand ends before ``place``."""
        text = bare[level.start : place]
        made = reader.add(level.start, place, None if level.going else text, arrow=level.arrow)
        done = made or level.going
        if done is not None:
            done.end_line = max(done.end_line, reader.line_at(level.start + len(text.rstrip()) - 1 if text.strip() else place))
        level.start, level.arrow, level.going = place + 1, False, None

    for m in _TOKEN[lang].finditer(bare):
        token, place, level = m[0], m.start(), levels[-1]
        if token in "([":
            level.brackets.append([token, 0])
        elif token == "=>":
            level.arrow |= not level.brackets
        elif token == ",":
            if level.brackets and level.brackets[-1][0] == "{":
                level.brackets[-1][1] = place + 1
        elif token == "{":
            if _is_literal(bare, place, lang):
                level.brackets.append(["{", place + 1])
                continue
            own = not level.brackets
            text = bare[level.start : place]
            if own and not level.going:
                made = reader.add(level.start, place, text, True, level.arrow)
            elif lang == "es" and level.brackets[-1:] and level.brackets[-1][0] == "{":
                made = reader.add(level.start, place, bare[level.brackets[-1][1] : place], True)
            elif lang == "go" and [b for b, _ in level.brackets] == ["("] and re.match(r"\s*(?:type\b|\w+\s+struct\s*$)", text):
                made = reader.add(level.start, place, text if text.lstrip().startswith("type") else text.lstrip(), True)
            else:
                made = reader.add(level.start, place, None if level.going or not level.arrow else text, arrow=level.arrow)
                if made is not None:  # a function whose body is the rest of its statement
                    level.going, made = made, None
            level.start = place + 1
            if made is not None and made.kind == "nameless":
                named = re.compile(r"[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\s*(\w+)\s*;").match(bare, place + 1)
                made.kind, made.name = ("class", named[1]) if named else (None, None)
                made = made if named else None
            levels.append(_Level(made, place + 1, own))
        elif token in ")]}":
            at = next((i for i in reversed(range(len(level.brackets))) if level.brackets[i][0] == _PAIR[token]), None)
            if at is not None and (token == "}" or all(b != "{" for b, _ in level.brackets[at:])):
                del level.brackets[at:]
            elif token == "}" and len(levels) > 1:
                finish(level, place)
                levels.pop()
                if level.decl is not None:
                    level.decl.end_line = reader.line_at(place)
                outer = levels[-1]
                outer.start = place + 1
                if level.own:
                    outer.arrow, outer.going = False, None
        elif level.brackets:
            continue
        elif token == ";":
            finish(level, place)
        elif bare[level.start : place].strip():  # a line's end
            head = bare[level.start : place].rstrip()[-24:]
            if not _GOES_ON[lang].search(head) and not _FOLLOWS[lang].match(bare, place):
                finish(level, place)
    for level in reversed(levels):
        last = reader.line_at(max(len(bare.rstrip()) - 1, 0))
        if level is levels[-1]:
            finish(level, len(bare))
        if level.decl is not None:
            level.decl.end_line = last


#: What no line within brackets begins with: a bracket was never closed.
_SURELY_NEW = re.compile(r"\n[ \t]*(?:def|class|return|raise|while|try|import|@|async\s+def)\b")


def _indented(reader: _Reader) -> None:
    bare, levels = reader.bare, reader.levels
    indents: list[int] = []
    start, depth, last = 0, 0, 1
    ends = [m for m in _TOKEN["python"].finditer(bare)]

    def close(indent: int) -> None:
        while indents and indents[-1] >= indent:
            indents.pop()
            levels.pop().decl.end_line = last

    def line(begin: int, end: int) -> None:
        nonlocal last
        text = bare[begin:end]
        if not text.strip():
            return
        head = text[: len(text) - len(text.lstrip())].rpartition("\n")[2]
        indent = len(head.expandtabs())
        close(indent)
        made = reader.add(begin, end, text)
        last = reader.line_at(begin + len(text.rstrip()) - 1)
        if made is not None:
            indents.append(indent)
            levels.append(_Level(made, end))

    for m in ends:
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth = max(0, depth - 1)
        elif (not depth and not bare[start : m.start()].endswith("\\")) or (depth and _SURELY_NEW.match(bare, m.start())):
            line(start, m.start())
            start, depth = m.start() + 1, 0
    line(start, len(bare))
    close(0)


def statements(path: str, text: str, lang: str) -> tuple[list[Statement], str]:
    """(the statements of a file, its text without comments and strings of several lines)."""
    bare, code = blanked(text, lang)
    reader = _Reader(path, text, bare, lang)
    (_indented if lang == "python" else _braced)(reader)
    return [r for r in reader.rows if r.kind is not None or r.function_seq is not None], code
