"""From calls to functions: exports, bindings, modules and the ranked call join.

Facts are tables:

* ``functions(path, name, exported)``
* ``reexports(path, seq, exported, local, has_specifier, target)``, ``target``
  being the file that the specifier resolves to
* ``bindings(path, local, imported, target, ord)`` in the order in which they
  were bound; the last is tried first
* ``modules(path, local, target, ord)``; the last one wins
* ``calls(path, caller, callee, receiver)``, an empty receiver for a bare call

A call that resolves nowhere leaves no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import edge, node_id
from graphloom.operators.resolve import directory
from graphloom.session import cut


def shares_scope(path: Column) -> Column:
    """Whether the files of a directory see each other's functions."""
    return path.endswith(".go")


def exported_names(functions: DataFrame, reexports: DataFrame) -> DataFrame:
    """(path, name, def_path, def_name): what a file offers under a name.

    Its own exported functions come first; then the first re-export of the
    name, whose function must be exported where it is defined, one hop away.
    """
    own = functions.where("exported").select("path", "name").distinct()
    direct = own.select("path", "name", F.col("path").alias("def_path"), F.col("name").alias("def_name"))
    first = reexports.groupBy("path", F.col("exported").alias("name")).agg(F.min_by(F.struct("local", "has_specifier", "target"), "seq").alias("r"))
    first = first.join(own, ["path", "name"], "left_anti")
    aimed = first.select("path", "name", F.when(F.col("r.has_specifier"), F.col("r.target")).otherwise(F.col("path")).alias("def_path"), F.col("r.local").alias("def_name"))
    offered = own.select(F.col("path").alias("def_path"), F.col("name").alias("def_name"))
    return direct.unionByName(aimed.join(offered, ["def_path", "def_name"], "left_semi").select("path", "name", "def_path", "def_name"))


def offered_by_directory(exported: DataFrame) -> DataFrame:
    """(dir, name, def_path, def_name): the first file of a shared scope that offers a name."""
    shared = exported.where(shares_scope(F.col("path"))).withColumn("dir", directory(F.col("path")))
    first = shared.groupBy("dir", "name").agg(F.min(F.struct("path", "def_path", "def_name")).alias("f"))
    return first.select("dir", "name", F.col("f.def_path").alias("dir_path"), F.col("f.def_name").alias("dir_name"))


def in_module(wanted: DataFrame, exported: DataFrame, scopes: bool = True) -> DataFrame:
    """``wanted`` (…, target, name) with the function that the module offers, if any.

    A target in a shared scope stands for its whole directory.
    """
    near = exported.select(F.col("path").alias("target"), "name", "def_path", "def_name")
    if not scopes:
        out = wanted.join(near, ["target", "name"])
        return out.withColumn("found", F.struct(F.col("def_path").alias("path"), F.col("def_name").alias("name"))).drop("def_path", "def_name")
    wide = offered_by_directory(exported)
    out = wanted.join(near, ["target", "name"], "left").withColumn("dir", F.when(shares_scope(F.col("target")), directory(F.col("target"))))
    out = out.join(wide, ["dir", "name"], "left")
    found = F.struct(F.coalesce("def_path", "dir_path").alias("path"), F.coalesce("def_name", "dir_name").alias("name"))
    return out.withColumn("found", found).where("found.path IS NOT NULL").drop("dir", "def_path", "def_name", "dir_path", "dir_name")


def resolve_calls(
    calls: DataFrame, functions: DataFrame, reexports: DataFrame, bindings: DataFrame, modules: DataFrame, scopes: bool = True,
) -> DataFrame:
    """Call edges between functions, each once; without ``scopes`` no directory shares its functions.

    A qualified call goes through its module alone. A bare one goes to the same
    file, exported or not; then, in a shared scope, to the first sibling file
    that has the function; then through its bindings, the last one first.
    """
    named = functions.select("path", "name").distinct()
    calls = calls.join(named.select("path", F.col("name").alias("caller")), ["path", "caller"], "left_semi").distinct()
    exported = cut(exported_names(functions, reexports), "exported")  # several branches read it

    qualified = calls.where("receiver <> ''").join(
        modules.groupBy("path", F.col("local").alias("receiver")).agg(F.max_by("target", "ord").alias("target")), ["path", "receiver"]
    )
    qualified = in_module(qualified.select("path", "caller", "target", F.col("callee").alias("name")), exported, scopes)
    qualified = qualified.select("path", "caller", F.col("found.path").alias("to_path"), F.col("found.name").alias("to_name"))

    bare = calls.where("receiver = ''").select("path", "caller", "callee")
    local = bare.join(named.select("path", F.col("name").alias("callee")), ["path", "callee"], "left_semi")
    local = local.select("path", "caller", F.col("path").alias("to_path"), F.col("callee").alias("to_name"))

    rest = bare.join(named.select("path", F.col("name").alias("callee")), ["path", "callee"], "left_anti")
    unbound, siblings = rest, local.where("false")
    if scopes:
        scoped = named.where(shares_scope(F.col("path"))).groupBy(directory(F.col("path")).alias("dir"), F.col("name").alias("callee")).agg(F.min("path").alias("to_path"))
        placed = rest.withColumn("dir", F.when(shares_scope(F.col("path")), directory(F.col("path"))))
        siblings = placed.join(scoped, ["dir", "callee"]).select("path", "caller", "to_path", F.col("callee").alias("to_name"))
        unbound = placed.join(scoped, ["dir", "callee"], "left_anti").select("path", "caller", "callee")
    tried = unbound.join(bindings.select("path", F.col("local").alias("callee"), F.col("imported").alias("name"), "target", "ord"), ["path", "callee"])
    bound = in_module(tried, exported, scopes).groupBy("path", "caller", "callee").agg(F.max_by("found", "ord").alias("found"))
    bound = bound.select("path", "caller", F.col("found.path").alias("to_path"), F.col("found.name").alias("to_name"))

    all_calls = qualified.unionByName(local).unionByName(siblings).unionByName(bound)
    ends = edge(node_id("function", F.col("path"), F.col("caller")), node_id("function", F.col("to_path"), F.col("to_name")), "calls")
    return all_calls.select(*ends).distinct()
