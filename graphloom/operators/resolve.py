"""From import specifiers to files: ranked candidates and a first-match join.

Each rule turns (path, specifier) into an array of candidate paths in order.
``first_match`` explodes them, joins the file list and keeps each import's
first hit; what resolves to nothing leaves no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions in the order in which they are tried.
ES_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def directory(path: Column) -> Column:
    """The path of the file's directory, empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalised(path: Column) -> Column:
    """``.`` and ``..`` worked out; null if the path leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    zero = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.lit(None))
    return F.array_join(F.aggregate(parts, zero, step), "/")


def joined(base: Column, relative: Column) -> Column:
    return normalised(F.concat_ws("/", F.nullif(base, F.lit("")), relative))


def es_candidates(path: Column, specifier: Column) -> Column:
    """Relative ES-module specifiers: the name itself, .js for .ts, extensions, index files."""
    target = joined(directory(path), specifier)
    js = F.regexp_replace(target, r"\.js$", "")
    swapped = F.when(target.endswith(".js"), F.array(F.concat(js, F.lit(".ts")), F.concat(js, F.lit(".tsx")))).when(
        target.endswith(".jsx"), F.array(F.concat(F.regexp_replace(target, r"\.jsx$", ""), F.lit(".tsx")))
    ).otherwise(F.array().cast("array<string>"))
    plain = F.array(*(F.concat(target, F.lit(f".{e}")) for e in ES_EXTENSIONS))
    index = F.array(*(F.concat_ws("/", F.nullif(target, F.lit("")), F.lit(f"index.{e}")) for e in ES_EXTENSIONS))
    found = F.concat(F.array(target), swapped, plain, index)
    return F.when(specifier.startswith("./") | specifier.startswith("../") | specifier.isin(".", ".."), found)


def python_candidates(path: Column, specifier: Column) -> Column:
    """Python modules: leading dots go up; absolute names from the root, then beside the importer."""
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    near = joined(directory(path), F.concat(up, rest))
    root = F.nullif(normalised(rest), F.lit(""))
    files_of = lambda base: F.array(F.concat(base, F.lit(".py")), F.concat_ws("/", F.nullif(base, F.lit("")), F.lit("__init__.py")))
    return F.when(dots > 0, files_of(near)).otherwise(F.concat(files_of(root), files_of(near)))


def include_candidates(path: Column, specifier: Column) -> Column:
    """Quoted includes: beside the includer, then from the root; angle brackets never."""
    quoted = F.array(joined(directory(path), specifier), normalised(specifier))
    return F.when(~specifier.startswith("<"), quoted)


def markdown_candidates(path: Column, target: Column) -> Column:
    """Exactly the relative path."""
    return F.array(joined(directory(path), target))


def first_match(imports: DataFrame, candidates: Column, paths: DataFrame) -> DataFrame:
    """(path, import_seq, target): the first candidate that is a file."""
    tried = imports.select("path", "import_seq", F.posexplode(candidates).alias("rank", "target")).where("target IS NOT NULL")
    known = paths.select(F.col("path").alias("target")).distinct()
    return tried.join(known, "target").groupBy("path", "import_seq").agg(F.min_by("target", "rank").alias("target"))


def package_anchors(paths: DataFrame) -> DataFrame:
    """(dir, anchor): a Go package's file of its own name, else its first file."""
    go = paths.where(F.col("path").endswith(".go")).select("path", directory(F.col("path")).alias("dir"))
    named = F.concat(F.substring_index("dir", "/", -1), F.lit(".go"))
    other = (F.substring_index("path", "/", -1) != named).cast("int")
    return go.groupBy("dir").agg(F.min(F.struct(other.alias("other"), "path")).alias("best")).select("dir", F.col("best.path").alias("anchor"))


def only_package(imports: DataFrame, anchors: DataFrame) -> DataFrame:
    """(path, import_seq, target) of Go imports without a module file: the package that the
    specifier names without its first segments, if only one does."""
    parts = F.split("specifier", "/")
    tails = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts) - k), "/")))
    tried = imports.select("path", "import_seq", F.explode(tails).alias("dir")).join(anchors, "dir")
    one = tried.groupBy("path", "import_seq").agg(F.min("anchor").alias("target"), F.max("anchor").alias("other"))
    return one.where("target = other").select("path", "import_seq", "target")


def nearest(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """(path, name, src_dir): of the named directories, the one that shares most leading
    segments with the path, ties to the first directory."""
    pairs = wanted.join(named.select("name", "src_dir"), "name")
    here, there = F.split(directory(F.col("path")), "/"), F.split("src_dir", "/")
    same = F.transform(F.arrays_zip(here.alias("a"), there.alias("b")), lambda z: z["a"].eqNullSafe(z["b"]).cast("int"))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")),
                         lambda s, x: F.struct((s["n"] + s["on"] * x).alias("n"), (s["on"] * x).alias("on")), lambda s: s["n"])
    return pairs.groupBy("path", "name").agg(F.min(F.struct((-shared).alias("far"), "src_dir")).alias("best")).select("path", "name", F.col("best.src_dir").alias("src_dir"))
