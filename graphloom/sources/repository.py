"""A source tree as tables: files, symbols, imports and calls.

Each file is lexed and cut into statements in one pass (``statements``), and the
facts of all files are one table. What statements say - names, calls, imports, bindings - is read
with Spark's expressions and resolved by joins. This reads the forms that code uses day to day
and recovers from broken files; macros aren't expanded and types aren't followed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import edge, node_id, top_directory
from graphloom.operators import calls as call_rules
from graphloom.operators import extract, regions, resolve
from graphloom.session import cut, planned_once
from graphloom.sources.statements import KEYWORDS, statements
from graphloom.sources.tree import walk

LANGUAGE = {
    "py": "python", "ts": "es", "tsx": "es", "js": "es", "jsx": "es", "mjs": "es", "cjs": "es", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c", "hh": "c", "hxx": "c",
}
#: Source extensions that pair with a header, in order.
PAIRS = ("c", "cc", "cpp", "cxx")


def language(path: Column) -> Column:
    """A key of DECLARATIONS by extension, case-sensitive; null for others."""
    extension = F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGE.items() for x in pair)), extension)


FACTS = (
    "path string, lang string, seq long, line int, end_line int, kind string, name string, of string, owner string, space string, "
    "outer boolean, function_seq long, text string"
)


def facts(files: DataFrame) -> DataFrame:
    """A row for each declaration and each statement within a function, and one of kind ``code`` with
    each file's text without comments.

    ``seq`` is the place in the file, ``function_seq`` that of the innermost function, which for a function is
    itself; ``outer`` tells that no function, class or scope is around. A file is one row of the
    input, so memory is bounded by the longest one.
    """
    columns = [c.split()[0] for c in FACTS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in FACTS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text"))):
                found, code = statements(path, text or "", lang)
                rows = [(path, lang, s.seq, s.line, s.end_line, s.kind, s.name, s.of, s.owner, s.space, s.outer, s.function_seq, s.text) for s in found]
                rows.append((path, lang, -1, 0, 0, "code", None, None, None, None, None, None, code))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=columns)

    known = files.select("path", language(F.col("path")).alias("lang"), "text").where("lang IS NOT NULL")
    return known.mapInArrow(read, FACTS)


def symbols(facts: DataFrame) -> DataFrame:
    """(path, seq, kind, name, start_line, end_line, exported), in order of places."""
    found = facts.where("kind IN ('function', 'class')")
    # Members carry their class's name.
    owner = F.coalesce(F.nullif("of", F.lit("")), F.when(F.col("kind") != "class", F.col("owner")))
    # C++: a name within a namespace carries its path; a member defined outside its
    # class carries the class's.
    plain = F.concat_ws(".", owner, F.when(F.col("lang") == "c", F.replace("name", F.lit("::"), F.lit("."))).otherwise(F.col("name")))
    name = F.concat_ws("::", F.nullif("space", F.lit("")), plain)
    outer = F.col("outer") & owner.isNull() & ~((F.col("lang") == "c") & (F.instr("name", "::") > 0))
    exported = (
        F.when(F.col("lang") == "python", outer & ~F.col("name").startswith("_"))
        .when(F.col("lang") == "go", outer & F.col("name").rlike("^[A-Z]"))
        .when(F.col("lang") == "rust", outer & F.col("text").rlike(r"^pub\b"))
        .when(F.col("lang") == "c", outer & ~F.col("text").rlike(r"^[^(]*\bstatic\b"))
        .otherwise(outer & F.col("text").rlike(r"^(?:@.*\s)?export\b"))
    )
    return found.select("path", "seq", "kind", name.alias("name"), F.col("line").alias("start_line"), "end_line", exported.alias("exported"))


_NAMES = r"\w+(?:\s*,\s*\w+)*"


def go_locals(facts: DataFrame) -> DataFrame:
    """(path, function_seq, ident): the names that a Go function declares anywhere in it, its
    parameters, closures and receiver included. They are values there and no packages or
    functions, wherever in the function they stand."""
    go = facts.where("lang = 'go' AND function_seq IS NOT NULL")
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), 1)
    params = F.when(F.col("text").rlike(r"\bfunc\b"), every(rf"[(,]\s*({_NAMES})\s+(?:\.\.\.)?[\w*\[\].]")).otherwise(F.array().cast("array<string>"))
    lists = F.concat(every(rf"({_NAMES})\s*:="), every(rf"^(?:var|const)\s+({_NAMES})"), params)
    names = go.select("path", "function_seq", F.explode(lists).alias("names"))
    return names.select("path", "function_seq", F.explode(F.split("names", r"\s*,\s*")).alias("ident")).distinct()


#: A name or path before a bracket that is no member of a call's result no constructor and no
#: name of a function expression; in ES with type arguments between.
_CALL = r"(?<![\w.~])(?<!::)(?<!->)(?<!\bnew )(?<!\bfunction )((?:\w+(?:\.|::|->))*\w+)%s\s*\("


#: The languages that a tree may have. Functions that get those it has leave out what only others need.
LANGUAGES = frozenset(LANGUAGE.values())


def calls(facts: DataFrame, declared: DataFrame, langs: frozenset[str] = LANGUAGES) -> DataFrame:
    """(path, lang, caller, callee, receiver) of calls inside functions; the innermost one calls.

    In C++ a ``::`` names a namespace and not a module: the callee keeps its path, and a
    bare one means the nearest namespace around the caller in which its file defines it.
    """
    found = F.regexp_extract_all("text", F.lit(_CALL % ""), 1)
    if "es" in langs:
        found = F.when(F.col("lang") == "es", F.regexp_extract_all("text", F.lit(_CALL % r"(?:<[\w\s,.|\[\]]*>)?"), 1)).otherwise(found)
    rows = facts.where("function_seq IS NOT NULL AND coalesce(kind, 'function') = 'function'").select("path", "function_seq", "lang", F.explode(found).alias("callee_path"))
    rows = rows.withColumn("callee_path", F.replace("callee_path", F.lit("->"), F.lit(".")))
    # A value's method is no function of a module in Rust and C++; only paths are followed.
    rows = rows.where(~F.col("lang").isin("rust", "c") | (F.instr("callee_path", ".") == 0))
    rows = rows.withColumn("callee_path", F.when(F.col("lang") == "c", F.col("callee_path")).otherwise(F.replace("callee_path", F.lit("::"), F.lit("."))))
    receiver = F.when(F.instr("callee_path", ".") > 0, F.regexp_replace("callee_path", r"\.\w+$", "")).otherwise(F.lit(""))
    rows = rows.select("path", "function_seq", "lang", F.substring_index("callee_path", ".", -1).alias("callee"), receiver.alias("receiver"))
    rows = rows.where(~F.col("callee").isin(*sorted(KEYWORDS)) & (F.col("lang").isin("python", "rust") | (F.instr("receiver", ".") == 0)))
    rows = rows.withColumn("ident", F.when(F.col("receiver") != "", F.col("receiver")).otherwise(F.col("callee")))
    held = rows.join(go_locals(facts), ["path", "function_seq", "ident"], "left_anti") if "go" in langs else rows
    named = declared.where("kind = 'function'").select("path", F.col("seq").alias("function_seq"), F.col("name").alias("caller"))
    made = held.join(named, ["path", "function_seq"]).select("path", "lang", "caller", "callee", "receiver").distinct()
    if "c" not in langs:
        return made
    # Namespaces from the caller's own outwards, then none.
    space = F.split(F.regexp_extract("caller", r"^((?:\w+::)*)", 1), "::")
    depth = F.size(space) - 1
    tries = F.transform(F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0))), lambda k: F.array_join(F.concat(F.slice(space, 1, depth - k), F.array("callee")), "::"))
    bare = made.where((F.col("lang") == "c") & (F.instr("callee", "::") == 0) & (F.instr("caller", "::") > 0))
    known = declared.select("path", F.col("name").alias("full")).distinct()
    near = bare.select("path", "caller", "callee", F.posexplode(tries).alias("k", "full")).join(known, ["path", "full"])
    near = near.groupBy("path", "caller", "callee").agg(F.min_by("full", "k").alias("full"))
    made = made.join(near, ["path", "caller", "callee"], "left")
    return made.select("path", "lang", "caller", F.coalesce("full", "callee").alias("callee"), "receiver").distinct()


def used_paths(statement: Column) -> Column:
    """(full, local) of each name that a Rust ``use`` or ``mod`` statement binds."""
    @F.pandas_udf("array<struct<full:string,local:string>>")
    def expand(statements: pd.Series) -> pd.Series:
        return pd.Series([[{"full": f, "local": n} for f, n in expand_use(s)] for s in statements], dtype=object)

    return expand(statement)


def expand_use(statement: str) -> list[tuple[str, str]]:
    """The paths of a statement, lists within lists opened, wildcards left out; ``self`` names its list's path."""
    word, _, rest = statement.partition(" ")
    if word == "mod":
        return [(f"self::{rest.strip()}", rest.strip())]
    out: list[tuple[str, str]] = []
    todo = [("", rest)]
    while todo:
        above, text = todo.pop()
        depth, part, parts = 0, "", []
        for c in text:
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        for part in [*parts, part]:
            head, brace, inner = part.partition("{")
            path, _, alias = head.strip().partition(" as ")
            whole = "::".join(x for x in (above, *(y.strip() for y in path.split("::"))) if x)
            if brace:
                todo.append((whole, inner[: inner.rfind("}")] if "}" in inner else inner))
            elif whole and not whole.endswith("*"):
                whole = whole.removesuffix("::self")
                out.append((whole, alias.strip() or whole.rpartition("::")[2]))
    return out


def imports(files: DataFrame, langs: frozenset[str] = LANGUAGES) -> DataFrame:
    """(path, import_seq, specifier, local, imported, is_namespace): a row for each bound
    name, and one without a name for an import that binds none."""
    lang = language(F.col("path"))
    es = files.where(lang == "es").select("path", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r"""(?m)^\s*((?:import|export)\b[^;'"]*['"][^'"\n]+['"])"""), 1)).alias("import_seq", "s"))
    es = es.select("path", "import_seq", F.regexp_extract("s", r"""['"]([^'"]+)['"]$""", 1).alias("specifier"), F.regexp_replace("s", r"\s+", " ").alias("s"))
    es = es.where(F.col("s").rlike(r"\bfrom\b|^import ?['\"]"))
    listed = F.regexp_extract("s", r"\{([^}]*)\}", 1)
    space = F.regexp_extract("s", r"\* as (\w+)", 1)
    names = F.filter(F.transform(F.split(listed, ","), lambda x: F.btrim(F.regexp_replace(x, r"^\s*type\s+", ""))), lambda x: x != "")
    pairs = F.transform(names, lambda x: F.struct(
        F.regexp_extract(x, r"(\w+)$", 1).alias("local"), F.regexp_extract(x, r"^(\w+)", 1).alias("imported"), F.lit(False).alias("is_namespace")))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("local"), F.lit(None).cast("string").alias("imported"), F.lit(False).alias("is_namespace")))
    one = lambda c: F.array(F.struct(c.alias("local"), F.lit(None).cast("string").alias("imported"), F.lit(True).alias("is_namespace")))
    bound = F.when(F.col("s").startswith("export"), nothing).when(space != "", one(space)).when(F.size(names) > 0, pairs).otherwise(nothing)
    es = es.select("path", "import_seq", "specifier", F.inline(bound))

    python = files.where(lang == "python").select("path", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r"(?m)^\s*(from\s+[.\w]+\s+import\s+(?:\([^)]*\)|[^\n#]+)|import\s+[^\n#]+)"), 1)).alias("import_seq", "s"))
    python = python.withColumn("s", F.btrim(F.regexp_replace("s", r"[()\s]+", " ")))
    module = F.regexp_extract("s", r"^from ([.\w]+)", 1)
    after = F.regexp_replace("s", r"^from [.\w]+ import |^import ", "")
    names = F.filter(F.transform(F.split(after, ","), lambda x: F.btrim(x)), lambda x: x != "")
    python = python.select("path", "import_seq", module.alias("module"), F.explode(names).alias("n"))
    whole, local = F.regexp_extract("n", r"^([.\w]+)", 1), F.regexp_extract("n", r"([.\w]+)$", 1)
    python = python.select(
        "path", "import_seq", F.when(F.col("module") != "", F.col("module")).otherwise(whole).alias("specifier"), local.alias("local"),
        F.when(F.col("module") != "", whole).alias("imported"), (F.col("module") == "").alias("is_namespace"))

    go = files.where(lang == "go").select("path", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r'(?m)^(?:import[ \t]+|[ \t]+)((?:[\w.]+[ \t]+)?"[^"\n]+")[ \t]*(?://.*)?\r?$'), 1)).alias("import_seq", "s"))
    specifier = F.regexp_extract("s", r'"([^"]+)"', 1)
    alias = F.regexp_extract("s", r"^(\w+|\.)\s", 1)  # a dot binds every exported name
    go = go.select("path", "import_seq", specifier.alias("specifier"), F.when(alias != "", alias).otherwise(F.substring_index(specifier, "/", -1)).alias("local"),
                   F.lit(None).cast("string").alias("imported"), F.lit(True).alias("is_namespace"))
    include = files.where(lang == "c").select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r'(?m)^\s*#\s*include\s*"([^"\n]+)"'), 1)).alias("import_seq", "specifier"))
    include = include.select("path", "import_seq", "specifier", *(F.lit(None).cast("string").alias(c) for c in ("local", "imported")), F.lit(False).alias("is_namespace"))

    rust = files.where(lang == "rust").select("path", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r"(?m)^\s*((?:pub(?:\([^)]*\))?\s+)?(?:use\s+[^;]+|mod\s+\w+));"), 1)).alias("import_seq", "s"))
    rust = rust.withColumn("s", F.btrim(F.regexp_replace(F.regexp_replace("s", r"^pub(\([^)]*\))?\s+", ""), r"\s+", " ")))
    rust = rust.select("path", "import_seq", F.startswith("s", F.lit("mod ")).alias("is_mod"), F.inline(used_paths(F.col("s"))))
    leaf = F.when(~F.col("is_mod"), F.regexp_extract("full", r"(\w+)$", 1))
    as_name = rust.where("NOT is_mod").select("path", "import_seq", "full", "local", leaf.alias("imported"), F.lit(False).alias("is_namespace"))
    as_space = rust.select("path", "import_seq", "full", "local", F.lit(None).cast("string").alias("imported"), F.lit(True).alias("is_namespace"))
    rust = as_name.unionByName(as_space).select("path", "import_seq", F.col("full").alias("specifier"), "local", "imported", "is_namespace")
    parts = [part for name, part in (("es", es), ("python", python), ("go", go), ("c", include), ("rust", rust)) if name in langs]
    return reduce(DataFrame.unionByName, parts) if parts else es.where("false")


def reexports(files: DataFrame) -> DataFrame:
    """(path, seq, exported, local, has_specifier, specifier) of ES export clauses."""
    rows = files.where(language(F.col("path")) == "es").select("path", F.posexplode(F.regexp_extract_all(
        "text", F.lit(r"""(?m)^\s*(export\s*\{[^}]*\}(?:\s*from\s*['"][^'"\n]+['"])?)"""), 1)).alias("k", "s"))
    names = F.filter(F.transform(F.split(F.regexp_extract("s", r"\{([^}]*)\}", 1), ","), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    specifier = F.regexp_extract("s", r"""['"]([^'"]+)['"]$""", 1)
    rows = rows.select("path", "k", specifier.alias("specifier"), F.posexplode(names).alias("j", "n"))
    return rows.select(
        "path", (F.col("k").cast("long") * 2**31 + F.col("j")).alias("seq"), F.regexp_extract("n", r"(\w+)$", 1).alias("exported"),
        F.regexp_extract("n", r"^(\w+)", 1).alias("local"), (F.col("specifier") != "").alias("has_specifier"), "specifier")


def prototypes(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Re-exports (path, seq, exported, local, has_specifier, target) of functions that a
    header declares at the level of a file or a namespace: they live in the source file of
    the same stem beside it."""
    heads = facts.where("kind = 'prototype'")
    name = F.concat_ws("::", F.nullif("space", F.lit("")), "name")
    heads = heads.select("path", "seq", name.alias("exported"), name.alias("local"))
    stem = F.regexp_replace("path", r"\.\w+$", "")
    pairs = F.array(*(F.concat(stem, F.lit(f".{e}")) for e in PAIRS))
    mates = resolve.first_match(heads.select("path").distinct().withColumn("import_seq", F.lit(0)), pairs, files).select("path", "target")
    return heads.join(mates, "path").select("path", "seq", "exported", "local", F.lit(True).alias("has_specifier"), "target")


def crates(files: DataFrame) -> DataFrame:
    """(name, src_dir): the source directory of each crate of the tree, that holds its
    ``lib.rs`` or ``main.rs``. The manifest beside it names it, else its directory does."""
    root = files.where(F.col("path").rlike(r"^(?:.*/)?src/(?:lib|main)\.rs$")).select(resolve.directory(F.col("path")).alias("src_dir")).distinct()
    root = root.withColumn("crate_dir", F.regexp_replace("src_dir", "/?src$", ""))
    manifests = files.where((F.col("path") == "Cargo.toml") | F.col("path").endswith("/Cargo.toml"))
    package = F.regexp_extract("text", r"(?ms)^\s*\[package\](.*?)(?=^\s*\[|\z)", 1)
    stated = F.regexp_extract(package, r'(?m)^\s*name\s*=\s*"([^"\n]*)"', 1)
    manifests = manifests.select(resolve.directory(F.col("path")).alias("crate_dir"), F.nullif(stated, F.lit("")).alias("stated"))
    name = F.coalesce("stated", F.nullif(F.substring_index("crate_dir", "/", -1), F.lit("")))
    return root.join(manifests, "crate_dir", "left").select(F.replace(name, F.lit("-"), F.lit("_")).alias("name"), "src_dir").where("name IS NOT NULL")


def rust_candidates(path: Column, specifier: Column, crate_src: Column) -> Column:
    """Module files of a ``use`` path, whole first, then without its last segments.

    ``crate`` is the nearest ``src``; ``self`` is the file's own children, ``super``
    its parent's; a first segment that names a crate of the tree (``crate_src``, else
    null) is that crate, and what is no module there is an item of its root file;
    another first segment is tried as a child module.
    """
    here = resolve.directory(path)
    stem = F.regexp_extract(path, r"([^/]*)\.rs$", 1)
    own = F.when(stem.isin("mod", "lib", "main"), here).otherwise(F.concat_ws("/", F.nullif(here, F.lit("")), stem))
    src = F.regexp_extract(path, r"^((?:.*/)?src)/", 1)
    ups = F.length(F.regexp_extract(specifier, r"^((?:super::)*)", 1)) / F.length(F.lit("super::"))
    up = F.repeat(F.lit("../"), ups.cast("int"))
    base = (
        F.when(specifier.startswith("crate::"), src).when(specifier.startswith("super::"), resolve.joined(own, up))
        .when(specifier.startswith("self::"), own).otherwise(F.coalesce(crate_src, own)))
    named = crate_src.isNotNull()
    rest = F.when(named, F.regexp_replace(specifier, r"^\w+(?:::)?", "")).otherwise(F.regexp_replace(specifier, r"^(?:crate::|self::|(?:super::)+)", ""))
    parts = F.filter(F.split(rest, "::"), lambda x: x != "")
    under = lambda x: F.concat_ws("/", F.nullif(base, F.lit("")), x)
    shorter = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"),
    )).otherwise(F.array().cast("array<string>"))
    modules = F.flatten(F.transform(F.transform(shorter, under), lambda x: F.array(F.concat(x, F.lit(".rs")), F.concat(x, F.lit("/mod.rs")))))
    roots = F.array(*(under(F.lit(f"{n}.rs")) for n in ("mod", "lib", "main")), F.concat(base, F.lit(".rs")))
    return F.concat(modules, F.when(named, roots).otherwise(F.array().cast("array<string>")))


def _candidates(path: Column, specifier: Column, go_module: Column, crate_src: Column, langs: frozenset[str]) -> Column:
    lang = language(path)
    inner = F.when(specifier.rlike(r"^\.\.?/"), resolve.joined(resolve.directory(path), specifier)).when(
        F.startswith(specifier, F.concat(go_module, F.lit("/"))), F.substring(specifier, F.length(go_module) + 2, F.length(specifier)))
    rules = {
        "es": resolve.es_candidates, "python": resolve.python_candidates, "go": lambda *_: F.array(inner), "c": resolve.include_candidates,
        "rust": lambda p, x: rust_candidates(p, x, crate_src),
    }
    return F.coalesce(*(F.when(lang == name, rule(path, specifier)) for name, rule in rules.items() if name in langs), F.array().cast("array<string>"))


def resolved(files: DataFrame, wanted: DataFrame, langs: frozenset[str] = LANGUAGES) -> DataFrame:
    """(path, specifier, target) of distinct (path, specifier) pairs that resolve."""
    paths = files.select("path")
    pairs = wanted.select("path", "specifier").distinct().withColumn("import_seq", F.xxhash64("path", "specifier"))
    pairs = pairs.withColumn("go_module", F.lit(None).cast("string")).withColumn("crate_src", F.lit(None).cast("string"))
    targets = paths
    if "go" in langs:
        mods = files.where("path = 'go.mod'").select(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("go_module"))
        # One row at most: the module line of the root's go.mod.
        pairs = pairs.drop("go_module").withColumn("one", F.lit(1)).join(F.broadcast(mods.limit(1).withColumn("one", F.lit(1))), "one", "left").drop("one")
        anchors = resolve.package_anchors(paths)
        targets = paths.unionByName(anchors.select(F.col("dir").alias("path")))
    if "rust" in langs:
        # The crate of the tree that a path may begin with.
        first = F.when(language(F.col("path")) == "rust", F.regexp_extract("specifier", r"^(\w+)", 1))
        pairs = pairs.drop("crate_src").withColumn("name", first)
        asked = pairs.where(~F.col("name").isin("crate", "self", "super")).select("path", "name").distinct()
        near = resolve.nearest(asked, crates(files)).select("path", "name", F.col("src_dir").alias("crate_src"))
        pairs = pairs.join(near, ["path", "name"], "left")
    hit = resolve.first_match(pairs, _candidates(F.col("path"), F.col("specifier"), F.col("go_module"), F.col("crate_src"), langs), targets)
    if "go" in langs:
        hit = hit.join(anchors.select(F.col("dir").alias("target"), "anchor"), "target", "left").select("path", "import_seq", F.coalesce("anchor", "target").alias("target"))
        legacy = pairs.where((language(F.col("path")) == "go") & F.col("go_module").isNull() & ~F.col("specifier").rlike(r"^\.\.?/"))
        hit = hit.unionByName(resolve.only_package(legacy, anchors))
    return pairs.join(hit, ["path", "import_seq"]).select("path", "specifier", "target")


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the source tree below ``root``."""
    # Texts are read once; the rules below read them several times.
    return graph_of(cut(walk(spark, root), "facts-files"))


#: Rows of facts up to which a tree's names are resolved as planned, without adaptive stages.
FEW = 200_000


def graph_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``files`` (path, text)."""
    # Facts are written once; five branches read them.
    found = cut(facts(files), "facts")
    rows = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = frozenset(rows)
    if sum(rows.values()) > FEW:
        return _graph(files, found, langs)
    with planned_once(files.sparkSession):
        nodes, edges = _graph(files, found, langs)
        return cut(nodes, "map-nodes"), cut(edges, "map-edges")


def _graph(files: DataFrame, found_facts: DataFrame, langs: frozenset[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files and their facts, of the given languages."""
    code = found_facts.where("kind = 'code'").select("path", "text")
    declared = cut(extract.symbol_ids(symbols(found_facts)), "facts-symbols")
    counts = declared.groupBy("path").agg(F.count_if(F.col("kind") == "function").alias("f"), F.count_if(F.col("kind") == "class").alias("c"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = files.join(counts, "path", "left")
    label = F.when(regions.language_of(F.col("path")) == "Other", "Plain").otherwise(regions.language_of(F.col("path")))
    summary = extract.file_summary(label, extract.line_count(F.col("text")), zero("f"), zero("c"))
    nodes = known.select(
        node_id("file", F.col("path")).alias("node_id"), F.lit("file").alias("kind"), F.substring_index("path", "/", -1).alias("name"), "path",
        summary.alias("summary"), top_directory(F.col("path")).alias("layer"), F.lit("structural").alias("provenance"))
    said = F.concat(F.initcap("kind"), F.lit(" "), "name", F.lit(", lines "), "start_line", F.lit("-"), "end_line")
    symbol_id = node_id(F.col("kind"), F.col("path"), F.col("symbol"))
    nodes = nodes.unionByName(declared.select(
        symbol_id.alias("node_id"), "kind", F.col("name"), "path", said.alias("summary"), F.lit(None).cast("string").alias("layer"), F.lit("structural").alias("provenance")))

    stated, offered = cut(imports(code, langs), "facts-imports"), reexports(code)
    offered = offered if "es" in langs else offered.where("false")
    names = stated.where("imported IS NOT NULL AND NOT is_namespace")
    deep = F.concat(F.col("specifier"), F.when(F.col("specifier").endswith("."), "").otherwise("."), F.col("imported"))
    as_module = names.where(language(F.col("path")) == "python").select("path", "import_seq", "local", "imported", "specifier", deep.alias("module"))
    made = cut(calls(found_facts, declared, langs), "facts-calls")
    # A Rust path before a call may name a module that no ``use`` binds.
    reached = made.where((language(F.col("path")) == "rust") & (F.col("receiver") != "")).select("path", "receiver").distinct()
    reached = reached.withColumn("specifier", F.replace("receiver", F.lit("."), F.lit("::")))
    wanted = [stated.select("path", "specifier")]
    wanted += [reached.select("path", "specifier")] if "rust" in langs else []
    wanted += [as_module.select("path", F.col("module").alias("specifier"))] if "python" in langs else []
    wanted += [offered.where("has_specifier").select("path", "specifier")] if "es" in langs else []
    found = cut(resolved(files, reduce(DataFrame.unionByName, wanted), langs), "facts-resolved")
    module_of = found.select("path", F.col("specifier").alias("module"), F.col("target").alias("module_target"))
    with_modules = names.withColumn("module", F.lit(None).cast("string")).withColumn("module_target", F.lit(None).cast("string"))
    if "python" in langs:
        with_modules = names.withColumn("module", F.when(language(F.col("path")) == "python", deep)).join(module_of, ["path", "module"], "left")
    with_modules = cut(with_modules.join(found, ["path", "specifier"], "left"), "facts-bound")

    order = lambda part: F.struct(F.col("import_seq"), F.lit(part).alias("part"))
    bindings = with_modules.select("path", "local", "imported", F.col("module_target").alias("target"), order(0).alias("ord")).unionByName(
        with_modules.select("path", "local", "imported", "target", order(1).alias("ord"))).where("target IS NOT NULL")
    spaces = stated.where("is_namespace").join(found, ["path", "specifier"]).select("path", "local", "target", order(0).alias("ord"))
    modules = spaces.unionByName(with_modules.where("module_target IS NOT NULL").select("path", "local", F.col("module_target").alias("target"), order(1).alias("ord")))

    if "rust" in langs:
        unbound = reached.join(found, ["path", "specifier"])
        modules = modules.unionByName(unbound.select("path", F.col("receiver").alias("local"), "target", F.struct(F.lit(-1).alias("import_seq"), F.lit(0).alias("part")).alias("ord")))

    whole = stated.where("imported IS NULL OR is_namespace").join(found, ["path", "specifier"]).select("path", "target")
    by_name = with_modules.select("path", F.coalesce("module_target", "target").alias("target")).where("target IS NOT NULL")
    imported = whole.unionByName(by_name).where("path <> target").distinct()
    # Every bare callee that a file does not define is offered to each of its includes in C,
    # and to each of its dot imports in Go.
    if langs & {"c", "go"}:
        lang = language(F.col("path"))
        included = stated.where((lang == "c") | ((lang == "go") & (F.col("local") == "."))).join(found, ["path", "specifier"])
        loose = made.where(lang.isin("c", "go") & (F.col("receiver") == "")).select("path", "callee").distinct()
        offers = included.join(loose, "path").select("path", F.col("callee").alias("local"), F.col("callee").alias("imported"), "target", order(0).alias("ord"))
        bindings = bindings.unionByName(offers)
    functions = declared.where("kind = 'function'").select("path", "name", "exported")
    if "es" in langs:
        offered = offered.join(found, ["path", "specifier"], "left").select("path", "seq", "exported", "local", "has_specifier", "target")
        # A local name in an export clause is exported by it.
        listed = offered.where("NOT has_specifier").select("path", F.col("local").alias("name")).distinct().withColumn("listed", F.lit(True))
        functions = functions.join(listed, ["path", "name"], "left").select("path", "name", (F.col("exported") | F.coalesce("listed", F.lit(False))).alias("exported"))
    else:
        offered = files.sparkSession.createDataFrame([], "path string, seq long, exported string, local string, has_specifier boolean, target string")
    if "c" in langs:
        offered = offered.unionByName(prototypes(found_facts, files.select("path")))
    called = call_rules.resolve_calls(made, functions, offered, bindings, modules, "go" in langs)
    file_id = node_id("file", F.col("path"))
    edges = (
        declared.select(*edge(file_id, symbol_id, "contains"))
        .unionByName(declared.where("exported").select(*edge(file_id, symbol_id, "exports")))
        .unionByName(imported.select(*edge(file_id, node_id("file", F.col("target")), "imports")))
        .unionByName(called)
    )
    return nodes, edges


#: Bytes of a source file that a reader is shown.
SHOWN = 512 * 1024


def source_envelope(files: DataFrame, nodes: DataFrame, wanted: str, cap: int = SHOWN) -> DataFrame:
    """(path, language, text, truncated) of one mapped file.

    Only the id of a file node of the map names a file. A cut goes back to
    where a character ends.
    """
    mapped = nodes.where((F.col("kind") == "file") & (F.col("node_id") == wanted)).select("path").distinct()
    data = F.col("text").cast("binary")
    starts = [F.try_validate_utf8(F.substring(data, 1, cap - k).cast("string")) for k in range(4)]
    shown = F.when(F.octet_length(data) <= cap, F.col("text")).otherwise(F.coalesce(*starts))
    found = files.join(mapped, "path", "left_semi")
    return found.select("path", regions.language_of(F.col("path")).alias("language"), shown.alias("text"), (F.octet_length(data) > cap).alias("truncated"))
