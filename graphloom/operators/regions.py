"""Regions, their weight, complexity and links, and the project's tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import files, relating, top_directory
from graphloom.session import numbered

UNROUTED = "no-call-flow"
TOP = 6

#: File extension to language.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript",
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "rs": "Rust", "py": "Python", "go": "Go", "c": "C", "h": "C",
    "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++",
    "md": "Markdown", "json": "JSON", "css": "CSS", "html": "HTML", "toml": "TOML", "yml": "YAML", "yaml": "YAML",
}


def language_of(path: Column) -> Column:
    """The language of a path's extension, or ``Other``."""
    name = F.substring_index(path, "/", -1)
    extension = F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit("")))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension), F.lit("Other"))


def file_regions(nodes: DataFrame) -> DataFrame:
    """(path, region) of every file by its layer."""
    return files(nodes).select("path", F.coalesce("layer", F.lit("root")).alias("region"))


def node_regions(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """(node_id, region): symbols are in their file's region."""
    return nodes.select("node_id", "path").join(regions, "path").select("node_id", "region")


def region_weight(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(region, weight): ends of relating edges; an edge inside counts twice.

    Ends are first counted by node, so that a join never carries the edges of a
    node that very many others relate to.
    """
    ends = relating(edges).select(F.explode(F.array("source", "target")).alias("node_id"))
    by_node = ends.groupBy("node_id").agg(F.count("*").alias("n"))
    return by_node.join(member, "node_id").groupBy("region").agg(F.sum("n").alias("weight"))


def complexity(n_files: Column, weight: Column) -> Column:
    """simple, moderate or complex by relating edges a file."""
    per_file = weight / F.nullif(n_files, F.lit(0))
    return F.when(n_files == 0, "simple").when(per_file < 1, "simple").when(per_file < 3, "moderate").otherwise("complex")


def _described(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    weight = F.coalesce("weight", F.lit(0)).cast("long")
    return sizes.join(weights, "region", "left").withColumn("weight", weight).withColumn("complexity", complexity(F.col("n_files"), F.col("weight")))


def structural_regions(nodes: DataFrame, edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Declared layers, empty ones too, and those that files name besides."""
    regions = file_regions(nodes)
    found = regions.groupBy("region").agg(F.count("*").alias("n_files"))
    declared = layers.select(F.col("layer_id").alias("region"), "name", "description")
    sizes = declared.join(found, "region", "full_outer")
    default = F.when(F.col("region") == "root", "Files at the repository root").otherwise(F.concat(F.lit("Files under "), "region", F.lit("/")))
    sizes = sizes.select(
        "region", F.coalesce("name", "region").alias("name"), F.coalesce(F.nullif("description", F.lit("")), default).alias("description"),
        F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"),
    )
    return _described(sizes, region_weight(edges, node_regions(nodes, regions)))


def _rooted(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """``steps`` with the path of their root, which is looked up where they don't have it."""
    return steps if "path" in steps.columns else steps.join(nodes.select(F.col("node_id").alias("root"), "path"), "root")


def domain_owners(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(path, region) of files by the first flow that runs through them, in the order of roots' paths.

    Steps are first brought to one row a node, in the task that has them.
    """
    claims = _rooted(nodes, steps).groupBy("node_id").agg(F.min(F.col("path")).alias("root_path"))
    first = claims.join(nodes.select("node_id", "path"), "node_id").groupBy("path").agg(F.min("root_path").alias("root_path"))
    owned = files(nodes).select("path").join(first, "path", "left")
    region = F.when(F.col("root_path").isNull(), F.lit(UNROUTED)).otherwise(top_directory(F.col("root_path")))
    return owned.select("path", region.alias("region"))


def domain_regions(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """A region for each domain with flows, and one for what no flow runs through."""
    roots = _rooted(nodes, steps.where("pos = 0"))
    flows = roots.groupBy(top_directory(F.col("path")).alias("region")).agg(F.count("*").alias("n_flows"))
    owners = domain_owners(nodes, steps)
    found = owners.groupBy("region").agg(F.count("*").alias("n_files"))
    sizes = found.join(flows, "region", "full_outer")
    many = F.when(F.col("n_flows") == 1, " call flow rooted here").otherwise(" call flows rooted here")
    sizes = sizes.select(
        "region", F.when(F.col("region") == UNROUTED, "No call flow").otherwise(F.col("region")).alias("name"),
        F.when(F.col("region") == UNROUTED, "Files no call flow runs through").otherwise(F.concat(F.coalesce("n_flows", F.lit(0)), many)).alias("description"),
        F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"),
    )
    return _described(sizes, region_weight(edges, node_regions(nodes, owners)))


def regions_of(nodes: DataFrame, edges: DataFrame, layers: DataFrame, steps: DataFrame, grouping: str = "structural") -> DataFrame:
    """The regions of a map by its directories or by its domains (``steps`` of flows)."""
    if grouping not in ("structural", "domain"):
        raise ValueError(f"regions are structural or domain, not {grouping}")
    return structural_regions(nodes, edges, layers) if grouping == "structural" else domain_regions(nodes, edges, steps)


def region_links(nodes: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(source, target, n, label): relating edges between two regions."""
    member = node_regions(nodes, regions)
    joined = (
        relating(edges).select("source", "target", "kind")
        .join(member.select(F.col("node_id").alias("source"), F.col("region").alias("from")), "source")
        .join(member.select(F.col("node_id").alias("target"), F.col("region").alias("to")), "target")
        .where("from <> to")
    )
    tally = joined.groupBy("from", "to").agg(F.count("*").alias("n"), F.min("kind").alias("a"), F.max("kind").alias("b"))
    noun = F.when(F.col("a") == F.col("b"), F.regexp_replace("a", "s$", "")).otherwise(F.lit("link"))
    label = F.concat(F.col("n"), F.lit(" "), noun, F.when(F.col("n") == 1, "").otherwise("s"))
    return tally.select(F.col("from").alias("source"), F.col("to").alias("target"), "n", label.alias("label"))


def region_captions(regions: DataFrame, links: DataFrame) -> DataFrame:
    """(region, caption): which way a region leans."""
    leans = links.groupBy(F.col("source").alias("region")).agg(F.count("*").alias("on"))
    leaned = links.groupBy(F.col("target").alias("region")).agg(F.count("*").alias("by"))
    both = regions.select("region").distinct().join(leans, "region", "left").join(leaned, "region", "left").fillna(0, ["on", "by"])
    count = lambda n: F.concat(F.col(n), F.when(F.col(n) == 1, " region").otherwise(" regions"))
    lean = F.concat(count("by"), F.when(F.col("by") == 1, " leans").otherwise(" lean"), F.lit(" on it"))
    caption = (
        F.when((F.col("on") == 0) & (F.col("by") == 0), "Keeps to itself")
        .when(F.col("on") == 0, F.concat(F.lit("Foundation — "), lean))
        .when(F.col("by") == 0, F.concat(F.lit("A way in — leans on "), count("on")))
        .otherwise(F.concat(F.lit("Leans on "), F.col("on"), F.lit(" · "), lean))
    )
    return both.select("region", caption.alias("caption"))


def region_ratio(regions: DataFrame) -> DataFrame:
    """(region, n_files, ratio): size against the widest region."""
    sizes = regions.groupBy("region").agg(F.count("*").alias("n_files"))
    return sizes.withColumn("ratio", F.col("n_files") / F.max("n_files").over(Window.partitionBy()))


def language_counts(nodes: DataFrame) -> DataFrame:
    """(language, n) of files."""
    return files(nodes).groupBy(language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def project_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, regions and relationships."""
    of_nodes = nodes.agg(
        F.count_if(F.col("kind") == "file").alias("n_files"),
        F.count_distinct(F.when(F.col("kind") == "file", F.coalesce("layer", F.lit("root")))).alias("n_regions"),
        F.lit(1).alias("_one"),
    )
    of_edges = edges.agg(F.count_if(F.col("kind").isin("imports", "calls")).alias("n_relationships"), F.lit(1).alias("_one"))
    return of_nodes.join(of_edges, "_one").drop("_one")


def provenance_tally(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("provenance").agg(F.count("*").alias("n"))


def top_files(scored: DataFrame, top: int = TOP) -> DataFrame:
    """(rank, path, significance) of the most significant files."""
    best = scored.where("significance > 0").orderBy(F.desc("significance"), "path").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("significance"), "path"))
    return best.select(rank.alias("rank"), "path", "significance")


def contained_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, n_symbols, first, last): symbols under each file through contains."""
    held = edges.where("kind = 'contains'").join(nodes.select(F.col("node_id").alias("target"), "name"), "target")
    return held.groupBy(F.col("source").alias("file_id")).agg(
        F.count("*").alias("n_symbols"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )


def file_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, node_id, kind, name): the symbols under each file, a row each, for files of any size."""
    symbols = nodes.where("kind <> 'file'").select("node_id", F.col("kind").alias("symbol_kind"), "name")
    held = edges.where("kind = 'contains'").select(F.col("source").alias("file_id"), F.col("target").alias("node_id")).distinct()
    return held.join(symbols, "node_id").select("file_id", "node_id", F.col("symbol_kind").alias("kind"), "name")


def files_filter(nodes: DataFrame, needle: str) -> DataFrame:
    """(region, n_match, n_files) of regions with files whose path holds ``needle``."""
    hit = F.contains(F.lower("path"), F.lit(needle.strip().lower()))
    counts = file_regions(nodes).groupBy("region").agg(F.count_if(hit).alias("n_match"), F.count("*").alias("n_files"))
    return counts.where("n_match > 0")


def flows_by_domain(flows: DataFrame) -> DataFrame:
    """(domain, n_flows, first_flow): domains with the first of their flows."""
    return flows.groupBy("domain").agg(F.count("*").alias("n_flows"), F.min("flow_id").alias("first_flow"))


def domain_flow_list(flows: DataFrame) -> DataFrame:
    """(domain, domain_seq, seq, flow_id, name): flows in id order, under domains in order of first appearance.

    ``domain_seq`` is the place of the domain's first flow; rows stay rows, so that
    a domain with most of the flows isn't gathered.
    """
    placed = numbered(flows.select("flow_id", "domain", "name"), "flow_id")
    first = placed.groupBy("domain").agg(F.min("number").alias("domain_seq"))
    return placed.join(first, "domain").select("domain", "domain_seq", F.col("number").alias("seq"), "flow_id", "name")


def publishes_significance(nodes: DataFrame) -> DataFrame:
    """One row: whether any file of the map has a significance at all, be it 0."""
    if "significance" not in nodes.columns:
        return nodes.sparkSession.range(1).select(F.lit(False).alias("published"))
    return files(nodes).agg(F.coalesce(F.bool_or(F.col("significance").isNotNull()), F.lit(False)).alias("published"))


def known_stops(tour: DataFrame, nodes: DataFrame) -> DataFrame:
    """The tour's stops whose node is in the map."""
    return tour.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def flow_entries(nodes: DataFrame, edges: DataFrame, flows: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """(rank, node_id): the first distinct roots of a map's flows, in the flows' order.

    ``flows`` is (seq, steps). A map without flows shows, in map order, nodes of any
    kind that call something and are called by nothing.
    """
    if flows is not None and not flows.isEmpty():
        roots = flows.select("seq", F.get("steps", F.lit(0)).alias("node_id")).groupBy("node_id").agg(F.min("seq").alias("seq"))
        best = roots.join(nodes.select("node_id").distinct(), "node_id", "left_semi").orderBy("seq").limit(top)
        return best.select(F.row_number().over(Window.orderBy("seq")).alias("rank"), "node_id")
    calls = edges.where("kind = 'calls'")
    callers = calls.select(F.col("source").alias("node_id")).distinct()
    return entry_points(nodes, callers.join(calls.select(F.col("target").alias("node_id")).distinct(), "node_id", "left_anti"), top)


def entry_points(nodes: DataFrame, entries: DataFrame, top: int = TOP) -> DataFrame:
    """(rank, node_id): the first entry functions in map order; entries without paths are looked up among the nodes."""
    known = entries if "path" in entries.columns else nodes.join(entries.select("node_id"), "node_id", "left_semi")
    best = known.orderBy("path", "node_id").limit(top)
    return best.select(F.row_number().over(Window.orderBy("path", "node_id")).alias("rank"), "node_id")


def enriched_slots(*families: DataFrame) -> DataFrame:
    """One row: how many rows of the slot families a provider has written."""
    marks = None
    for df in families:
        rows = df.select("provenance")
        marks = rows if marks is None else marks.unionByName(rows)
    return marks.agg(F.count_if(F.col("provenance") == "llm").alias("n_enriched"), F.count("*").alias("n_slots"))


def symbol_files(nodes: DataFrame) -> DataFrame:
    """(node_id, file_id): the file that a symbol is in."""
    held = files(nodes).select("path", F.col("node_id").alias("file_id"))
    return nodes.where("kind <> 'file'").select("node_id", "path").join(held, "path").select("node_id", "file_id")
