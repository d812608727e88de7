"""The change overlay: changed nodes, unmapped paths and the one-hop radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut


def changed_nodes(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """All nodes, symbols included, whose path changed.

    Changed paths are written first: Spark then knows their size, and the map is only shuffled for many of them.
    """
    paths = cut(changed.select("path").distinct(), "changed")
    return nodes.join(paths, "path", "left_semi").select("node_id")


def unmapped_paths(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed paths that no node has."""
    return changed.select("path").distinct().join(nodes.select("path"), "path", "left_anti")


def blast_radius(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes one edge of any kind away from a changed node, in either direction.

    The changed nodes are written first, as in ``changed_nodes``.
    """
    ids = cut(changed.select("node_id"), "changed-nodes")
    out = edges.join(ids, edges["source"] == ids["node_id"], "left_semi").select(F.col("target").alias("node_id"))
    back = edges.join(ids, edges["target"] == ids["node_id"], "left_semi").select(F.col("source").alias("node_id"))
    return out.unionByName(back).distinct().join(ids, "node_id", "left_anti")


def overlay(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node_id, status): changed and affected nodes."""
    hit = changed_nodes(nodes, changed)
    near = blast_radius(edges, hit)
    return hit.withColumn("status", F.lit("changed")).unionByName(near.withColumn("status", F.lit("affected")))


def rolled_up(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """(node_id, status) of files: a mark on a symbol marks its file, changed first."""
    rank = F.when(F.col("status") == "changed", 0).otherwise(1)
    by_path = marks.join(nodes.select("node_id", "path"), "node_id").groupBy("path").agg(F.min(rank).alias("rank"))
    status = F.when(F.col("rank") == 0, "changed").otherwise("affected")
    return nodes.where("kind = 'file'").join(by_path, "path").select("node_id", status.alias("status"))
