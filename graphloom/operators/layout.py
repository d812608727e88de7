"""Places of regions, files and edge ends in a drawing, as functions of depth and order.

A view is one drawing. It has a bounded number of cards (``graph.DRAWN`` files, or
the regions of a map); views are independent and shared out among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.session import cut

COLUMNS = 4
#: Pixels of cards and gaps, and cards in a row of the standalone block.
CARD_WIDTH, CARD_HEIGHT, GAP, LAYER_GAP, STANDALONE_COLUMNS = 200, 58, 18, 72, 8
#: Pixels that a card's corner keeps free, between two ends, and of a handle.
INSET, PITCH, HANDLE = 14, 12, 6
#: Passes of averaging, and at most so many of swapping.
SWEEPS, SWAPS = 6, 4


def back_links(links: DataFrame) -> DataFrame:
    """(view, source, target) of links that close a cycle in a depth-first walk.

    ``links`` is (view, source, target); each view is a drawing of a bounded
    number of cards (``graph.DRAWN`` files, or the regions of a map), and is
    walked by itself, nodes and links in id order.
    """
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for a, b in sorted(set(zip(rows["source"], rows["target"]))):
            after.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        back = []
        for root in sorted({*rows["source"], *rows["target"]}):
            if root in state:
                continue
            state[root] = 1
            stack: list[tuple[str, Iterator[str]]] = [(root, iter(after.get(root, [])))]
            while stack:
                at, rest = stack[-1]
                to = next(rest, None)
                if to is None:
                    state[at] = 2
                    stack.pop()
                elif state.get(to) == 1:
                    back.append((at, to))
                elif to not in state:
                    state[to] = 1
                    stack.append((to, iter(after.get(to, []))))
        return pd.DataFrame([(rows["view"].iloc[0], a, b) for a, b in back], columns=["view", "source", "target"])

    return links.groupBy("view").applyInPandas(walk, "view string, source string, target string")


def view_depths(links: DataFrame) -> DataFrame:
    """(view, node_id, depth): how deep each card of a view lies, its back links left out.

    Links that close a cycle sit the depths out, and so do links of a card to itself;
    cards with no others have depth 0.
    """
    links = cut(links.select("view", "source", "target").distinct(), "view-links")
    ends = links.select("view", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    forward = links.join(back_links(links), ["view", "source", "target"], "left_anti")
    placed = lambda c: F.struct("view", F.col(c).alias("node_id")).alias(c)
    deep = graph.dependency_depth(forward.select(placed("source"), placed("target"))).select("node_id.*", "depth")
    return ends.join(deep, ["view", "node_id"], "left").select("view", "node_id", F.coalesce("depth", F.lit(0)).alias("depth"))


def grid(depth: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """(node_id, band, row, column): bands of equal depth, stacked by the rows they take."""
    banded = depth.select("node_id", "depth")
    sizes = banded.groupBy("depth").agg(F.count("*").alias("n"))
    w = Window.orderBy("depth")
    rows = F.ceil(F.col("n") / columns)
    sizes = sizes.withColumn("band", F.dense_rank().over(w) - 1).withColumn(
        "first_row", F.coalesce(F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = banded.withColumn("k", F.row_number().over(Window.partitionBy("depth").orderBy("node_id")) - 1).join(sizes, "depth")
    return placed.select(
        "node_id", F.col("band").cast("int").alias("band"), (F.col("first_row") + F.floor(F.col("k") / columns)).cast("int").alias("row"),
        (F.col("k") % columns).cast("int").alias("column"))


def uncrossed(band: np.ndarray, place: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Places within bands with few crossings.

    Each sweep puts the cards of a band in the order of the mean place of what they link
    from (going down), then to (going up); a card without such links keeps its place, and
    ties their order. Then neighbours change places while that saves crossings with the
    bands next to theirs: how many depends only on the two cards' own links.
    """
    place = place.astype(float)
    count = int(band.max()) + 1 if len(band) else 0
    members = [np.flatnonzero(band == b) for b in range(count)]
    members = [m[np.argsort(place[m], kind="stable")] for m in members]
    links = links[band[links[:, 0]] != band[links[:, 1]]]
    down, up = links, links[:, ::-1]

    def settle(b: int) -> None:
        place[members[b]] = np.arange(len(members[b]))

    def average(b: int, ends: np.ndarray) -> None:
        n = np.bincount(ends[:, 1], minlength=len(band))
        total = np.bincount(ends[:, 1], weights=place[ends[:, 0]], minlength=len(band))
        key = np.where(n > 0, total / np.maximum(n, 1), place)[members[b]]
        members[b] = members[b][np.argsort(key, kind="stable")]
        settle(b)

    for b in range(count):
        settle(b)
    for _ in range(SWEEPS):
        for b in range(1, count):
            average(b, down)
        for b in reversed(range(count - 1)):
            average(b, up)

    above = {c: down[(down[:, 1] == c) & (band[down[:, 0]] == band[c] - 1), 0] for c in range(len(band))}
    below = {c: up[(up[:, 1] == c) & (band[up[:, 0]] == band[c] + 1), 0] for c in range(len(band))}

    def crossings(left: int, right: int) -> int:
        """Of these two cards' links, if ``left`` stands left of ``right``."""
        return sum(int((place[near[left]][:, None] > place[near[right]][None, :]).sum()) for near in (above, below))

    for _ in range(SWAPS):
        better = False
        for row in members:
            for i in range(len(row) - 1):
                a, b = int(row[i]), int(row[i + 1])
                if crossings(b, a) < crossings(a, b):
                    row[i], row[i + 1] = b, a
                    place[a], place[b] = i + 1, i
                    better = True
        if not better:
            break
    return place.astype(int)


def ordered(cards: DataFrame, links: DataFrame) -> DataFrame:
    """(view, node_id, band, place) of ``cards`` (view, node_id, band, place), reordered
    within their bands for fewer crossings of ``links`` (view, source, target)."""
    def order(mine: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(["band", "place", "node_id"]).reset_index(drop=True)
        number = {n: i for i, n in enumerate(mine["node_id"])}
        ends = [(number[a], number[b]) for a, b in zip(between["source"], between["target"]) if a in number and b in number]
        mine["place"] = uncrossed(mine["band"].to_numpy(), mine.groupby("band").cumcount().to_numpy(), np.array(sorted(ends), int).reshape(-1, 2))
        return mine[["view", "node_id", "band", "place"]]

    return cards.groupBy("view").cogroup(links.groupBy("view")).applyInPandas(order, "view string, node_id string, band int, place int").where("node_id IS NOT NULL")


def drawing(placed: DataFrame, alone: DataFrame, height: int = CARD_HEIGHT) -> DataFrame:
    """(view, node_id, x, y): bands centred on each other, and below them a block of the
    cards without links.

    ``placed`` is the result of ``ordered``; ``alone`` is (view, node_id, place).
    """
    bands = placed.groupBy("view", "band").agg(F.count("*").alias("n"))
    shape = bands.groupBy("view").agg(F.max("n").alias("widest"), F.max("band").alias("last"))
    block = alone.groupBy("view").agg(F.least(F.lit(STANDALONE_COLUMNS), F.count("*")).alias("columns"))
    shape = shape.join(block, "view", "full").select(
        "view", F.coalesce("columns", F.lit(1)).alias("columns"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("n_bands"),
        F.greatest(F.coalesce("widest", F.lit(1)), F.coalesce("columns", F.lit(1))).alias("span"))
    pitch, step = CARD_WIDTH + GAP, height + LAYER_GAP
    linked = placed.join(bands, ["view", "band"]).join(shape, "view").select(
        "view", "node_id", ((F.col("place") - (F.col("n") - 1) / 2 + (F.col("span") - 1) / 2) * pitch).alias("x"),
        (F.col("band") * step).cast("double").alias("y"))
    k = F.row_number().over(Window.partitionBy("view").orderBy("place", "node_id")) - 1
    start = F.when(F.col("n_bands") > 0, F.col("n_bands") * step + LAYER_GAP).otherwise(0)
    parked = alone.withColumn("k", k).join(shape, "view").select(
        "view", "node_id", ((F.col("k") % F.col("columns") + (F.col("span") - F.col("columns")) / 2) * pitch).alias("x"),
        (start + F.floor(F.col("k") / F.col("columns")) * (height + GAP)).cast("double").alias("y"))
    return linked.unionByName(parked)


def fan_out(cards: DataFrame, edges: DataFrame, height: int = CARD_HEIGHT) -> DataFrame:
    """(view, edge_id, node_id, side, anchor, x, handle_x, handle_y): where edges meet cards.

    ``cards`` is (view, node_id, x, width), ``edges`` (view, edge_id, source, target). On
    each side of a card (source: bottom, target: top) its edges are ranked by the centre
    of the card at their other end, then by id, and spread between the insets; a single
    one keeps the middle. Where more edges meet a side than points fit on it, neighbours
    in rank share a point. Edges to cards that are not drawn have no row.
    """
    centre = F.col("x") + F.col("width") / 2
    end = lambda name: cards.select("view", F.col("node_id").alias(name), centre.alias(f"{name}_at"), F.col("width").alias(f"{name}_width"))
    both = edges.join(end("source"), ["view", "source"]).join(end("target"), ["view", "target"])
    sides = both.select("view", "edge_id", F.inline(F.array(*(
        F.struct(F.col(a).alias("node_id"), F.lit(a).alias("side"), F.col(f"{b}_at").alias("far"), F.col(f"{a}_width").alias("width"))
        for a, b in (("source", "target"), ("target", "source"))))))
    side = Window.partitionBy("view", "node_id", "side")
    span = F.greatest(F.lit(0), F.col("width") - 2 * INSET)
    ranked = sides.withColumn("k", F.row_number().over(side.orderBy("far", "edge_id")) - 1).withColumn("n", F.count("*").over(side))
    ranked = ranked.withColumn("used", F.least(F.col("n"), F.greatest(F.lit(1), F.floor(span / PITCH) + 1)))
    point = F.floor(F.col("k") * F.col("used") / F.col("n"))
    x = F.when(F.col("used") <= 1, F.col("width") / 2).otherwise(INSET + point * span / F.nullif(F.col("used") - 1, F.lit(0)))
    ranked = ranked.withColumn("point", point).withColumn("x", x.cast("double"))
    return ranked.select(
        "view", "edge_id", "node_id", "side", F.concat(F.substring("side", 1, 1), F.col("point").cast("string")).alias("anchor"), "x",
        (F.col("x") - HANDLE / 2).alias("handle_x"), F.when(F.col("side") == "target", 0).otherwise(height - HANDLE).cast("double").alias("handle_y"))
