"""Neighbourhoods, degrees, drill selections, shortest paths and depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import files, relating
from graphloom.session import Levels, cut, numbered

DRAWN = 40


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, n_in, n_out) over relating edges."""
    ends = relating(edges).select(F.inline(F.array(
        F.struct(F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )))
    return ends.groupBy("node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Files that a focus file imports or is imported by, and the focus itself.

    The focus and what is near are written first, as in ``touching``.
    """
    imports = edges.where("kind = 'imports' AND source <> target")
    ids = cut(focus.select("node_id"), "focus")
    out = imports.join(ids, imports["source"] == ids["node_id"], "left_semi").select(F.col("target").alias("node_id"))
    back = imports.join(ids, imports["target"] == ids["node_id"], "left_semi").select(F.col("source").alias("node_id"))
    near = cut(out.unionByName(back).unionByName(ids).distinct(), "near")
    return files(nodes).join(near, "node_id", "left_semi").select("node_id", "path")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Imports with both ends in ``ids``, self-imports left out."""
    inside = ids.select("node_id").distinct()
    kept = edges.where("kind = 'imports' AND source <> target")
    kept = kept.join(inside.select(F.col("node_id").alias("source")), "source", "left_semi")
    return kept.join(inside.select(F.col("node_id").alias("target")), "target", "left_semi").select("source", "target")


def drawn_files(nodes: DataFrame, scored: DataFrame, most: int = DRAWN) -> DataFrame:
    """(node_id, path, region, rank): each region's most significant files.

    The window's rank filter is applied before the shuffle as well, so a region
    with very many files sends ``most`` rows from each task.
    """
    ranked = files(nodes).select("node_id", "path", F.coalesce("layer", F.lit("root")).alias("region"))
    ranked = ranked.join(scored.select("node_id", "significance"), "node_id", "left").withColumn("significance", F.coalesce("significance", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("significance"), "path"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= most).select("node_id", "path", "region", "rank")


def regions_hiding(nodes: DataFrame, drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """Regions that hold a wanted file which is not drawn."""
    held = files(nodes).join(wanted.select("node_id").distinct(), "node_id", "left_semi")
    return held.join(drawn.select("node_id"), "node_id", "left_anti").select(F.coalesce("layer", F.lit("root")).alias("region")).distinct()


def standalone(drawn: DataFrame, edges: DataFrame) -> DataFrame:
    """Drawn files that no drawn import touches."""
    inside = induced(edges, drawn)
    touched = inside.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return drawn.join(touched, "node_id", "left_anti").select("node_id", "region")


def touching(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(node_id, other, other_name, kind, direction) of the edges at the focus nodes.

    The focus and then its edges are written first: Spark then knows their size, and edges are only shuffled
    for a large focus and nodes for many of its edges.
    """
    ids, names = cut(focus.select("node_id"), "focus"), nodes.select(F.col("node_id").alias("other"), F.col("name").alias("other_name"))
    out = edges.select(F.col("source").alias("node_id"), F.col("target").alias("other"), "kind", F.lit("uses").alias("direction"))
    back = edges.select(F.col("target").alias("node_id"), F.col("source").alias("other"), "kind", F.lit("used by").alias("direction"))
    touched = cut(out.unionByName(back).join(ids, "node_id", "left_semi"), "touched")
    return touched.join(names, "other").select("node_id", "other", "other_name", "kind", "direction")


def _both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, seq): each edge from both ends, numbered by its place in the list."""
    return cut(
        edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "edge_seq").unionByName(
            edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "edge_seq")
        ), "adjacency",
    )


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """(pos, node_id) of an undirected shortest path over all kinds; no rows if there is none.

    ``edges`` carry ``edge_seq``, their order in the map. Among shortest paths
    the one found first wins: a node's parent is the earliest of the frontier,
    then the earliest edge. The frontier grows level by level, each level one
    join against the adjacency, cut in the shared folder.
    """
    spark = nodes.sparkSession
    known = {r[0] for r in nodes.where(F.col("node_id").isin(start, end)).select("node_id").distinct().collect()}
    if not {start, end} <= known:
        return spark.createDataFrame([], "pos int, node_id string")
    around = _both_ways(edges)
    levels = [spark.createDataFrame([(start, None, 0)], "node_id string, parent string, ord long")]
    found = start == end
    while not found:
        # A neighbour of the frontier is on the level before it, on its own or on the next one.
        near = levels[-1].select("node_id") if len(levels) < 2 else levels[-1].select("node_id").unionByName(levels[-2].select("node_id"))
        front = levels[-1]
        reach = front.join(around, front["node_id"] == around["a"]).join(near.withColumnRenamed("node_id", "b"), "b", "left_anti")
        best = reach.groupBy("b").agg(F.min(F.struct("ord", "edge_seq", "node_id")).alias("by"))
        best = best.select(F.col("b").alias("node_id"), F.col("by.node_id").alias("parent"), F.col("by.ord").alias("of"), F.col("by.edge_seq").alias("seq"))
        level = cut(numbered(best, "of", "seq", "node_id").select("node_id", "parent", F.col("number").alias("ord")), "bfs")
        if level.isEmpty():
            return spark.createDataFrame([], "pos int, node_id string")
        levels.append(level)
        found = not level.where(F.col("node_id") == end).isEmpty()
    way = [end]
    for level in reversed(levels[1:]):
        way.append(level.where(F.col("node_id") == way[-1]).head()["parent"])
    return spark.createDataFrame(list(enumerate(reversed(way))), "pos int, node_id string")


def path_steps(nodes: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """(pos, node_id, name, path) of ``shortest_path`` between two picked nodes."""
    way = cut(shortest_path(nodes, edges, start, end), "path")  # as many rows as the path has nodes
    return nodes.select("node_id", "name", "path").join(F.broadcast(way), "node_id").select("pos", "node_id", "name", "path")


def highlighted(nodes: DataFrame, way: DataFrame) -> DataFrame:
    """``nodes`` with ``on_path``: whether each is on a path (node_id); on none if there is no path."""
    marked = way.select("node_id").distinct().withColumn("_on", F.lit(True))
    return nodes.join(marked, "node_id", "left").withColumn("on_path", F.coalesce("_on", F.lit(False))).drop("_on")


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node_id, depth): least number of undirected edges from the nearest start node."""
    around = cut(edges.select(F.inline(F.array(
        F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b"))
    ))).distinct(), "adjacency")
    levels = Levels(edges.sparkSession, "bfs", "node_id string")
    before, front = None, levels.append(start.select("node_id").distinct())
    while not front.isEmpty():
        # What is reached again is on the frontier or on the level before it.
        near = front if before is None else front.unionByName(before)
        reach = front.join(around, front["node_id"] == around["a"]).select(F.col("b").alias("node_id")).distinct()
        before, front = front, levels.append(reach.join(near, "node_id", "left_anti"))
    return levels.all().select("node_id", F.col("level").alias("depth"))


def dependency_depth(links: DataFrame) -> DataFrame:
    """(node_id, depth): the longest way down to a node from a node nothing links to.

    ``links`` (source, target) must hold no cycle. Nodes are peeled: one is settled
    in the round in which the last of its links arrives, and that round is its depth;
    each link is followed once. What is waiting for more links is all that a round
    carries on. Nodes that are never settled lie on a cycle or below one.
    """
    links = cut(links.select("source", "target").distinct(), "links")
    due = cut(links.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("due")), "links-due")
    heads = links.select(F.col("source").alias("node_id")).distinct().join(due, "node_id", "left_anti")
    levels, waiting = Levels(links.sparkSession, "depth", f"node_id {links.schema['source'].dataType.simpleString()}"), None
    front = levels.append(heads)
    while not front.isEmpty():
        came = front.join(links, front["node_id"] == links["source"]).groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("n"))
        if waiting is not None:
            came = came.unionByName(waiting).groupBy("node_id").agg(F.sum("n").alias("n"))
        here = cut(came.join(due, "node_id"), "depth-came")
        front = levels.append(here.where("n = due").select("node_id"))
        waiting = here.where("n < due").select("node_id", "n")
    depth = levels.all().select("node_id", F.col("level").alias("depth"))
    if depth.count() < links.select(F.explode(F.array("source", "target"))).distinct().count():
        raise ValueError("the links hold a cycle; cut its back links first")
    return depth


def bands(depth: DataFrame) -> DataFrame:
    """(depth, n_nodes, band): depths in use, numbered from 0."""
    sizes = depth.groupBy("depth").agg(F.count("*").alias("n_nodes"))
    return sizes.withColumn("band", F.dense_rank().over(Window.orderBy("depth")) - 1)
