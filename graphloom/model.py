"""The code graph's tables: nodes, edges, layers, flows, tour.

``nodes(node_id, kind, name, path, summary, layer, provenance)`` and
``edges(source, target, kind, weight)`` are plain DataFrames; symbols belong to
the file node of their path. Ids are made by ``node_id`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an edge of each kind weighs.
WEIGHTS = {"contains": 1.0, "imports": 0.7, "exports": 0.5, "calls": 0.9}
KINDS = ("file", "class", "function")
RELATING = ("imports", "calls")
NODE = "node_id string, kind string, name string, path string, summary string, layer string, provenance string"
EDGE = "source string, target string, kind string, weight double"


def node_id(kind: Column | str, path: Column, symbol: Column | None = None) -> Column:
    """``kind:path`` or ``kind:path:symbol``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", kind, path) if symbol is None else F.concat_ws(":", kind, path, symbol)


def weight(kind: Column) -> Column:
    """The weight of an edge kind; null for an unknown one."""
    out = F.lit(None).cast("double")
    for name, value in WEIGHTS.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def kind_rank(kind: Column) -> Column:
    """File before class before function."""
    return F.when(kind == "file", 0).when(kind == "class", 1).otherwise(2)


def top_directory(path: Column) -> Column:
    """The first directory of a path, or ``root``."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def edge(source: Column, target: Column, kind: str) -> list[Column]:
    """The columns of an edge."""
    return [source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.lit(WEIGHTS[kind]).alias("weight")]


def files(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'file'")


def relating(edges: DataFrame) -> DataFrame:
    """Imports and calls."""
    return edges.where(F.col("kind").isin(*RELATING))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, subject): what breaks the contract; no rows if nothing does."""
    repeated = nodes.groupBy("node_id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), F.col("node_id").alias("subject"))
    badly_named = nodes.where(~F.coalesce(F.col("node_id").rlike("^(file|function|class):"), F.lit(False)))
    unknown_kind = edges.where(weight(F.col("kind")).isNull())
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    dangling = ends.join(nodes.select("node_id"), "node_id", "left_anti")
    return (
        repeated.unionByName(badly_named.select(F.lit("malformed id").alias("rule"), F.col("node_id").alias("subject")))
        .unionByName(unknown_kind.select(F.lit("unknown edge kind").alias("rule"), F.col("kind").alias("subject")))
        .unionByName(dangling.select(F.lit("dangling edge").alias("rule"), F.col("node_id").alias("subject")))
    )
