"""SimHash near-dedup with BK-trees.

Fingerprints. A document's 3-word shingles are hashed with XXH64; a bit of the
64-bit fingerprint is set if it is set in over half of the hashes. This is a
map over the texts; only ids and fingerprints go on.

Shard trees. The bits are dealt into three blocks. Two fingerprints that differ
in at most two bits agree on one block at least, so every distinct fingerprint
is sent to three shards, one for each block, named by the first bits of that
block: all neighbours meet. How many bits name a shard follows from the number
of fingerprints, so that a shard has about ``SHARD`` members however large the
corpus. A shard of over ``MOST`` members, which only many fingerprints alike can
make, is dealt again by blocks of the bits that its members need not agree on,
until none is larger; after at most five rounds fewer than 14 bits are left, so
that a tree's size is bounded by construction.

In each shard a BK-tree is built, with children keyed by their integer Hamming
distance to the parent; a search with radius r at distance d follows only the
edges from d - r to d + r. All members are searched for in their shard's tree,
in batches, each step of which goes one edge down for all open searches.

Trees are not broadcast: a fingerprint would then have to visit every tree,
which grows with the square of the corpus. The shuffle takes each tree's
members, 8 bytes each and at most ``MOST`` of them, to the task that builds it.

Classes. A shard reports links from its members to the least member they
reach, so the links of a dense group grow with its size and not with its
square. Alternating large-star and small-star steps then join links over all
shards, each step cut in the shared folder.

Defined results: null and blank texts have fingerprint zero and link like any
other; a text of one or two words is one shingle; repeated rows share all
results; null ids are kept and are never a class's smallest id unless all of
its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Members of a shard: about so many, and never more than so many.
SHARD, MOST = 512, 16_384
#: Searches that go down a tree together.
TOGETHER = 256


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and the fingerprint ``fp`` as a signed long."""
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_signed(fingerprint(t)) for t in batch], dtype="int64")

    return docs.select(*carry, of(F.col(text_col)).alias("fp"))


class Tree:
    """A BK-tree over distinct unsigned 64-bit values; the first is the root.

    ``child[i, d]`` is the child of node i at distance d, or -1. It is built level
    by level: of all values that reach an edge, the first becomes its child and
    the others go on from there, as if they were inserted one after another.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        rest, at = np.arange(1, len(values)), np.zeros(max(len(values) - 1, 0), np.int64)
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            edge, first, of = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            made = rest[first]
            self.child[edge // 65, edge % 65] = made
            going = rest != made[of]
            rest, at = rest[going], made[of][going]

    def search(self, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(k, node): the nodes within ``radius`` of each wanted value k."""
        k, node = np.arange(len(wanted)), np.zeros(len(wanted), np.int64)
        ks, nodes = [], []
        while len(k):
            d = np.bitwise_count(self.values[node] ^ wanted[k]).astype(np.int64)
            near = d <= radius
            ks.append(k[near])
            nodes.append(node[near])
            edges = d[:, None] + np.arange(-radius, radius + 1)
            below = np.where((edges >= 0) & (edges <= 64), self.child[node[:, None], np.clip(edges, 0, 64)], -1)
            row, column = np.nonzero(below >= 0)
            k, node = k[row], below[row, column].astype(np.int64)
        return np.concatenate(ks), np.concatenate(nodes)


def shard_links(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links from members to the least member they reach within the shard."""
    members = np.unique(values.astype(np.int64))
    tree = Tree(members.view(np.uint64))
    parent = np.arange(len(members))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(members), TOGETHER):
        k, node = tree.search(tree.values[at : at + TOGETHER], radius)
        # Members that are joined already need no second look.
        a, b = parent[k + at], parent[node]
        for pair in np.unique((np.minimum(a, b) * len(members) + np.maximum(a, b))[a != b]).tolist():
            lo, hi = sorted((root(pair // len(members)), root(pair % len(members))))
            parent[hi] = lo
        while (parent[parent] != parent).any():
            parent = parent[parent]
    linked = np.flatnonzero(parent != np.arange(len(members)))
    return members[linked], members[parent[linked]]


def blocks(free: list[int], radius: int = RADIUS) -> list[list[int]]:
    """The bits ``free`` dealt into one block more than bits may differ."""
    return [free[k :: radius + 1] for k in range(radius + 1)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _sharded(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, mask, key) for each of ``masks``: the bits that name a shard, and their values."""
    kinds = F.array(*[
        F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
        for m in masks
    ])
    return rows.select("fp", F.inline(kinds))


def shards(distinct: DataFrame, radius: int = RADIUS, size: int = SHARD, most: int = MOST) -> DataFrame:
    """(mask, key, fps) of at most ``most`` members; all within ``radius`` of one another meet in one."""
    width = max(0, int(np.ceil(np.log2(max(distinct.count(), 1) / size))))
    masks = [_mask(block[:width]) for block in blocks(list(range(64)), radius)]
    rows, done = _sharded(distinct, masks), []
    while True:
        counts = rows.groupBy("mask", "key").agg(F.count("*").alias("n"))
        hot = cut(counts.where(F.col("n") > most).select("mask", "key"), "simhash-hot")
        if hot.isEmpty():
            break
        rows = cut(rows, "simhash-shards")
        done.append(rows.join(hot, ["mask", "key"], "left_anti"))
        over, split = rows.join(hot, ["mask", "key"], "left_semi"), []
        for mask in masks:
            free = [b for b in range(64) if not mask >> b & 1]
            finer = [mask | _mask(block) for block in blocks(free, radius)]
            split.append((_sharded(over.where(F.col("mask") == _signed(mask)).select("fp"), finer), finer))
        rows, masks = reduce(DataFrame.unionByName, [d for d, _ in split]), [m for _, ms in split for m in ms]
    whole = reduce(DataFrame.unionByName, [*done, rows])
    return whole.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), v < u: links that connect all of ``distinct.fp`` within ``radius``."""
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shard_links(np.asarray(fps), radius) for fps in batch["fps"]]
            us, vs = zip(*found) if found else ((), ())
            yield pd.DataFrame({"u": np.concatenate([np.zeros(0, np.int64), *us]), "v": np.concatenate([np.zeros(0, np.int64), *vs])})

    return shards(distinct, radius).select("fps").mapInPandas(link, "u long, v long").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """No node is below two others, or below one and above another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select(F.col("v"), F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.where("below > 1 OR (below > 0 AND above > 0)").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node: the least node of its component.

    ``least`` and ``under`` are written before they are joined, so that both
    sides of each join are dealt out for it alone and Spark can split the rows
    of a node with very many links.
    """
    edges = cut(links, "simhash-links")
    while not _is_forest_of_stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "simhash-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "simhash-large")
        under = cut(large.groupBy("u").agg(F.min("v").alias("m")), "simhash-under")
        small = large.join(under, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(under.select("u", F.col("m").alias("v"))).distinct(), "simhash-links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, first): the smallest ``_of`` of all rows that each fingerprint reaches."""
    firsts = cut(prints.groupBy("fp").agg(F.min("_of").alias("_first")), "simhash-distinct")
    roots = components(near_links(firsts.select("fp")))
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    whole = cut(rooted.groupBy("root").agg(F.min("_first").alias("first")), "simhash-firsts")
    return cut(rooted.select("fp", "root").join(whole, "root").select("fp", "first"), "simhash-classes")


def _named(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Fingerprints with ``_of``: id and text hash, null without an id."""
    of = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")))
    named = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), of.alias("_of"))
    return cut(fingerprints(named, "_text", ("_id", "_of")), "simhash-prints")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    prints = _named(docs, text_col, id_col)
    found = prints.select("_id", "fp").join(classes(prints), "fp")
    return found.select(F.col("_id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each class: that with the smallest id, once.

    Only ids and fingerprints are grouped; the texts are joined to the winners,
    by id and text hash, so that an id with two texts can stand for two
    classes. Rows without an id cannot be named and all stay.
    """
    winners = classes(_named(docs, text_col, id_col)).where("first IS NOT NULL").select("first.*").distinct()
    winners = cut(winners, "simhash-winners")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    kept = rows.join(winners, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
