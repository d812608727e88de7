"""The catalogue of graph queries over the bound tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import weight
from graphloom.operators import annotate, calls, extract, graph, overlay, redact, regions, resolve, retrieval, semantics, trigrams
from graphloom.session import cut, table
from graphloom.sources import bindings, published, repository, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T, C, D = bindings.TRADE_SQL, bindings.CHAIN_SQL, bindings.DOCUMENTS_SQL

#: Pieces of SQL that several queries share.
ENTRY = """
ent AS (SELECT node_id, path FROM nodes WHERE kind = 'function'
  AND node_id IN (SELECT source FROM edges WHERE kind = 'calls') AND node_id NOT IN (SELECT target FROM edges WHERE kind = 'calls'))"""
DEGREE = """
deg AS (SELECT n.node_id, n.path, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out
  FROM nodes n LEFT JOIN (SELECT target, count(*) AS c FROM edges WHERE kind = 'imports' GROUP BY 1) i ON i.target = n.node_id
  LEFT JOIN (SELECT source, count(*) AS c FROM edges WHERE kind = 'imports' GROUP BY 1) o ON o.source = n.node_id WHERE n.kind = 'file')"""
SCORED = ENTRY + "," + DEGREE + """,
sig AS (SELECT *, path IN (SELECT path FROM ent) AS is_entry,
  fan_in + fan_out + (path IN (SELECT path FROM ent))::BIGINT AS significance FROM deg)"""
CHANGED = """
chg AS (SELECT s_path AS path FROM s WHERE s_acctbal < 0 UNION SELECT 'labels/' || doc_id || '.md' FROM labels WHERE toxic = 1),
hit AS (SELECT node_id FROM nodes WHERE path IN (SELECT path FROM chg))"""
RADIUS = CHANGED + """,
near AS (SELECT node_id FROM (SELECT target AS node_id FROM edges WHERE source IN (SELECT node_id FROM hit)
  UNION SELECT source FROM edges WHERE target IN (SELECT node_id FROM hit)) WHERE node_id NOT IN (SELECT node_id FROM hit))"""
MEMBER = "reg AS (SELECT path, coalesce(layer, 'root') AS region FROM nodes WHERE kind = 'file'), mem AS (SELECT node_id, region FROM nodes JOIN reg USING (path))"
WEIGHT = """
ends AS (SELECT source AS node_id FROM edges WHERE kind IN ('imports', 'calls') UNION ALL SELECT target FROM edges WHERE kind IN ('imports', 'calls')),
wgt AS (SELECT region, count(*)::BIGINT AS weight FROM ends JOIN mem USING (node_id) GROUP BY 1)"""
COMPLEXITY = "CASE WHEN n_files = 0 OR weight / n_files < 1 THEN 'simple' WHEN weight / n_files < 3 THEN 'moderate' ELSE 'complex' END"
LAYERS = """
lay AS (SELECT DISTINCT CASE WHEN instr(path, '/') > 0 THEN split_part(path, '/', 1) ELSE 'root' END AS layer_id FROM nodes WHERE kind = 'file'),
layers AS (SELECT layer_id, layer_id AS name, CASE WHEN layer_id = 'root' THEN 'Files at the repository root' ELSE 'Files under ' || layer_id || '/' END AS description FROM lay)"""
#: On this graph a flow is an order and the parts it calls, in id order.
STEPS = ENTRY + """,
steps AS (SELECT node_id AS root, node_id, '' AS ord FROM ent UNION ALL SELECT DISTINCT source, target, target FROM edges WHERE kind = 'calls'),
pos AS (SELECT root, node_id, (row_number() OVER (PARTITION BY root ORDER BY ord) - 1)::INT AS pos FROM steps),
flows AS (SELECT 'flow:' || root AS flow_id, root, split_part(max(CASE WHEN pos = 0 THEN n.path END), '/', 1) AS domain,
  string_agg(n.name, ' → ' ORDER BY pos) AS name, count(*)::BIGINT AS n_steps FROM pos JOIN nodes n USING (node_id) GROUP BY root)"""
TOUR = """
sel AS (SELECT * FROM sig WHERE significance > 0 ORDER BY significance DESC, path LIMIT 12),
tour AS (SELECT (row_number() OVER (ORDER BY fan_out - fan_in + is_entry::BIGINT DESC, path) - 1)::INT AS pos, node_id,
  (CASE WHEN is_entry THEN 'Entry point: ' ELSE '' END) || path || ' — fan-in ' || fan_in || ', fan-out ' || fan_out AS label FROM sel)"""


def query(sql: str | None = None):
    """Register a query by its function's name."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return keep


def _trade(spark, sf_dir):
    return published.trade_map(spark, sf_dir)


def _scored(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return semantics.significance(nodes, edges)


def _contenders(spark, sf_dir):
    """Scored files for a tour, which is of the most significant."""
    return semantics.contenders(*_trade(spark, sf_dir))


def _changed(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    mapped = s.select(F.concat(F.lit("supplier/"), "n_name", F.lit("/s"), "s_suppkey", F.lit(".ts")).alias("path"))
    odd = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("labels/"), "doc_id", F.lit(".md")).alias("path"))
    return mapped.unionByName(odd).distinct()


# --- semantics ----------------------------------------------------------------------


@query(f"WITH {T},{LAYERS} SELECT *, 'structural' AS provenance FROM layers")
def layers(spark, sf_dir):
    return semantics.layers(_trade(spark, sf_dir)[0])


@query(f"WITH {T},{DEGREE} SELECT * FROM deg")
def import_degree(spark, sf_dir):
    return semantics.import_degree(*_trade(spark, sf_dir))


@query(f"WITH {T},{ENTRY} SELECT DISTINCT path FROM ent")
def entry_points(spark, sf_dir):
    return semantics.entry_point_files(*_trade(spark, sf_dir))


@query(f"WITH {T},{SCORED} SELECT node_id, path, fan_in, fan_out, is_entry, significance FROM sig")
def significance(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"WITH {T},{SCORED} SELECT node_id, path, significance FROM sig WHERE significance > 0 ORDER BY significance DESC, path LIMIT 12")
def tour_select(spark, sf_dir):
    return semantics.tour_selection(_contenders(spark, sf_dir)).select("node_id", "path", "significance")


@query(f"WITH {T},{SCORED},{TOUR} SELECT * FROM tour")
def tour(spark, sf_dir):
    return semantics.tour(_contenders(spark, sf_dir))


@query(f"WITH {T},{STEPS} SELECT flow_id, domain, name, n_steps FROM flows")
def domain_flows(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return semantics.flows(nodes, semantics.rooted_steps(nodes, edges, named=True))


_SUPPLY = """calls AS (SELECT DISTINCT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target FROM orders
 UNION SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
 UNION SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem)"""


@query(f"""WITH RECURSIVE {_SUPPLY}, root AS (SELECT DISTINCT source AS root FROM calls WHERE source LIKE 'customer:%'),
w(root, node_id, way) AS (SELECT root, root, [root] FROM root UNION ALL SELECT root, target, list_append(way, target) FROM w JOIN calls ON source = node_id),
best AS (SELECT root, node_id, min(way) AS way FROM w GROUP BY 1, 2)
SELECT root, node_id, (row_number() OVER (PARTITION BY root ORDER BY way) - 1)::INT AS pos FROM best""")
def supply_flow_steps(spark, sf_dir):
    """Customers to orders to parts to suppliers: three calls deep, with many ways to one node."""
    edges = bindings.supply(spark, sf_dir)
    # Only customers begin flows of this query: orders without an entry above them begin none.
    customers = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.concat(F.lit("customer:"), "o_custkey").alias("node_id"))
    nodes = customers.select("node_id", F.lit("function").alias("kind"), F.col("node_id").alias("path"))
    return semantics.flow_steps(nodes, edges.withColumn("kind", F.lit("calls")))


@query(f"WITH {T} SELECT kind, count(*)::BIGINT AS n, sum(weight * 10)::BIGINT AS tenths FROM edges GROUP BY 1")
def edge_weights(spark, sf_dir):
    edges = _trade(spark, sf_dir)[1]
    tenths = F.sum(F.round(weight(F.col("kind")) * 10).cast("long"))
    return edges.groupBy("kind").agg(F.count("*").alias("n"), tenths.alias("tenths"))


# --- overlay ------------------------------------------------------------------------


@query(f"WITH {T},{CHANGED} SELECT node_id FROM hit")
def changed_nodes(spark, sf_dir):
    return overlay.changed_nodes(_trade(spark, sf_dir)[0], _changed(spark, sf_dir))


@query(f"WITH {T},{CHANGED} SELECT path FROM chg WHERE path NOT IN (SELECT path FROM nodes)")
def unmapped_paths(spark, sf_dir):
    return overlay.unmapped_paths(_trade(spark, sf_dir)[0], _changed(spark, sf_dir))


@query(f"WITH {T},{RADIUS} SELECT node_id FROM near")
def blast_radius(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return overlay.blast_radius(edges, overlay.changed_nodes(nodes, _changed(spark, sf_dir)))


@query(f"""WITH {T},{RADIUS}, m AS (SELECT node_id, 0 AS r FROM hit UNION ALL SELECT node_id, 1 FROM near),
byp AS (SELECT path, min(r) AS r FROM m JOIN nodes USING (node_id) GROUP BY 1)
SELECT node_id, CASE r WHEN 0 THEN 'changed' ELSE 'affected' END AS status FROM nodes JOIN byp USING (path) WHERE kind = 'file'""")
def overlay_rollup(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return overlay.rolled_up(nodes, overlay.overlay(nodes, edges, _changed(spark, sf_dir)))


@query(f"WITH {T},{RADIUS} SELECT 'changed' AS status, count(*)::BIGINT AS n FROM hit HAVING n > 0 UNION ALL SELECT 'affected', count(*)::BIGINT AS n FROM near HAVING n > 0")
def overlay_counts(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return overlay.overlay(nodes, edges, _changed(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


# --- regions ------------------------------------------------------------------------


@query(f"""WITH {T},{MEMBER},{WEIGHT},{LAYERS}, sz AS (SELECT layer_id AS region, name, description, coalesce(n_files, 0)::BIGINT AS n_files, coalesce(weight, 0)::BIGINT AS weight
FROM layers LEFT JOIN (SELECT region, count(*) AS n_files FROM reg GROUP BY 1) r ON r.region = layer_id LEFT JOIN wgt w ON w.region = layer_id)
SELECT *, {COMPLEXITY} AS complexity FROM sz""")
def structural_regions(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return regions.structural_regions(nodes, edges, semantics.layers(nodes))


_OWNED = """
claim AS (SELECT n.path, min((r.path, p.root)) AS c FROM pos p JOIN nodes n USING (node_id) JOIN nodes r ON r.node_id = p.root GROUP BY 1),
own AS (SELECT f.path, coalesce(split_part(c[1], '/', 1), 'no-call-flow') AS region FROM nodes f LEFT JOIN claim USING (path) WHERE f.kind = 'file'),
mem AS (SELECT node_id, region FROM nodes JOIN own USING (path))"""


@query(f"""WITH {T},{STEPS},{_OWNED.replace('min((r.path, p.root)) AS c', "[min(r.path)] AS c")},{WEIGHT},
fl AS (SELECT domain AS region, count(*)::BIGINT AS n_flows FROM flows GROUP BY 1),
sz AS (SELECT coalesce(o.region, fl.region) AS region, coalesce(n_files, 0)::BIGINT AS n_files, coalesce(n_flows, 0) AS n_flows
  FROM (SELECT region, count(*) AS n_files FROM own GROUP BY 1) o FULL JOIN fl ON fl.region = o.region),
al AS (SELECT sz.*, coalesce(weight, 0)::BIGINT AS weight FROM sz LEFT JOIN wgt USING (region))
SELECT region, CASE region WHEN 'no-call-flow' THEN 'No call flow' ELSE region END AS name,
  CASE region WHEN 'no-call-flow' THEN 'Files no call flow runs through' ELSE n_flows || ' call flow' || CASE n_flows WHEN 1 THEN '' ELSE 's' END || ' rooted here' END AS description,
  n_files, weight, {COMPLEXITY} AS complexity FROM al""")
def domain_regions(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return regions.domain_regions(nodes, edges, semantics.rooted_steps(nodes, edges))


@query(f"WITH {T},{MEMBER},{WEIGHT} SELECT * FROM wgt")
def region_weight(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return regions.region_weight(edges, regions.node_regions(nodes, regions.file_regions(nodes)))


_LINKS = """
tal AS (SELECT a.region AS source, b.region AS target, count(*)::BIGINT AS n, min(kind) AS a, max(kind) AS b
  FROM edges JOIN mem a ON a.node_id = edges.source JOIN mem b ON b.node_id = edges.target
  WHERE kind IN ('imports', 'calls') AND a.region <> b.region GROUP BY 1, 2),
lnk AS (SELECT source, target, n, n || ' ' || (CASE WHEN a = b THEN regexp_replace(a, 's$', '') ELSE 'link' END) || CASE n WHEN 1 THEN '' ELSE 's' END AS label FROM tal)"""


@query(f"WITH {T},{MEMBER},{_LINKS} SELECT * FROM lnk")
def region_links(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return regions.region_links(nodes, edges, regions.file_regions(nodes))


@query(f"""WITH {T},{MEMBER},{_LINKS}, b AS (SELECT r.region, (SELECT count(*) FROM lnk WHERE source = r.region) AS o, (SELECT count(*) FROM lnk WHERE target = r.region) AS i FROM (SELECT DISTINCT region FROM reg) r)
SELECT region, CASE WHEN o = 0 AND i = 0 THEN 'Keeps to itself' WHEN o = 0 THEN 'Foundation — ' || i || CASE i WHEN 1 THEN ' region leans on it' ELSE ' regions lean on it' END
 WHEN i = 0 THEN 'A way in — leans on ' || o || CASE o WHEN 1 THEN ' region' ELSE ' regions' END
 ELSE 'Leans on ' || o || ' · ' || i || CASE i WHEN 1 THEN ' region leans on it' ELSE ' regions lean on it' END END AS caption FROM b""")
def region_caption(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    member = regions.file_regions(nodes)
    return regions.region_captions(member, regions.region_links(nodes, edges, member))


@query(f"WITH {T},{MEMBER}, z AS (SELECT region, count(*)::BIGINT AS n_files FROM reg GROUP BY 1) SELECT *, n_files / max(n_files) OVER () AS ratio FROM z")
def region_ratio(spark, sf_dir):
    return regions.region_ratio(regions.file_regions(_trade(spark, sf_dir)[0]))


@query(f"WITH {T},{SCORED} SELECT (row_number() OVER (ORDER BY significance DESC, path))::INT AS rank, path, significance FROM sig WHERE significance > 0 ORDER BY rank LIMIT 6")
def top_files(spark, sf_dir):
    return regions.top_files(_scored(spark, sf_dir))


@query(f"WITH {T} SELECT CASE layer WHEN 'supplier' THEN 'TypeScript' WHEN 'part' THEN 'Python' ELSE 'Go' END AS language, count(*)::BIGINT AS n FROM nodes WHERE kind = 'file' GROUP BY 1")
def language_counts(spark, sf_dir):
    return regions.language_counts(_trade(spark, sf_dir)[0])


@query(f"""WITH {T} SELECT (SELECT count(*) FROM nodes WHERE kind = 'file')::BIGINT AS n_files, (SELECT count(DISTINCT layer) FROM nodes WHERE kind = 'file')::BIGINT AS n_regions,
 (SELECT count(*) FROM edges WHERE kind IN ('imports', 'calls'))::BIGINT AS n_relationships""")
def project_counts(spark, sf_dir):
    return regions.project_counts(*_trade(spark, sf_dir))


@query(f"WITH {T} SELECT provenance, count(*)::BIGINT AS n FROM nodes GROUP BY 1")
def provenance_tally(spark, sf_dir):
    return regions.provenance_tally(_trade(spark, sf_dir)[0])


@query(f"WITH {T} SELECT source AS file_id, count(*)::BIGINT AS n_symbols, min(name) AS first_name, max(name) AS last_name FROM edges JOIN nodes ON node_id = target WHERE edges.kind = 'contains' GROUP BY 1")
def contained_symbols(spark, sf_dir):
    return regions.contained_symbols(*_trade(spark, sf_dir))


@query(f"WITH {T},{MEMBER} SELECT region, count(*) FILTER (contains(lower(path), 'brand#1'))::BIGINT AS n_match, count(*)::BIGINT AS n_files FROM reg GROUP BY 1 HAVING n_match > 0")
def files_filter(spark, sf_dir):
    return regions.files_filter(_trade(spark, sf_dir)[0], " Brand#1 ")


@query(f"WITH {T},{STEPS} SELECT domain, count(*)::BIGINT AS n_flows, min(flow_id) AS first_flow FROM flows GROUP BY 1")
def flows_by_domain(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return regions.flows_by_domain(semantics.flow_roots(nodes, edges))


@query(f"WITH {T},{STEPS}, k AS (SELECT *, row_number() OVER (ORDER BY flow_id) - 1 AS seq FROM flows) SELECT domain, min(seq) OVER (PARTITION BY domain)::BIGINT AS domain_seq, seq::BIGINT AS seq, flow_id, name FROM k")
def domain_flow_list(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return regions.domain_flow_list(semantics.flows(nodes, semantics.rooted_steps(nodes, edges, named=True)))


@query(f"WITH {T} SELECT DISTINCT source AS file_id, node_id, nodes.kind, name FROM edges JOIN nodes ON node_id = target WHERE edges.kind = 'contains' AND nodes.kind <> 'file'")
def file_symbols(spark, sf_dir):
    return regions.file_symbols(*_trade(spark, sf_dir))


# --- graph --------------------------------------------------------------------------


@query(f"""WITH {T}, e AS (SELECT source AS node_id, 0 AS i, 1 AS o FROM edges WHERE kind IN ('imports', 'calls') UNION ALL SELECT target, 1, 0 FROM edges WHERE kind IN ('imports', 'calls'))
SELECT node_id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM e GROUP BY 1""")
def degrees(spark, sf_dir):
    return graph.degrees(_trade(spark, sf_dir)[1])


_TOP = "top AS (SELECT node_id FROM sig WHERE significance > 0 ORDER BY significance DESC, path LIMIT 12)"


def _top(spark, sf_dir):
    return semantics.tour_selection(_contenders(spark, sf_dir)).select("node_id")


@query(f"""WITH {T},{SCORED},{_TOP}, x AS (SELECT target AS node_id FROM edges WHERE kind = 'imports' AND source IN (SELECT * FROM top)
 UNION SELECT source FROM edges WHERE kind = 'imports' AND target IN (SELECT * FROM top) UNION SELECT * FROM top)
SELECT node_id, path FROM nodes WHERE kind = 'file' AND node_id IN (SELECT node_id FROM x)""")
def neighbourhood(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return graph.neighbourhood(nodes, edges, _top(spark, sf_dir))


_DRAWN = "drawn AS (SELECT * FROM (SELECT node_id, path, layer AS region, (row_number() OVER (PARTITION BY layer ORDER BY significance DESC, path))::INT AS rank FROM nodes JOIN sig USING (node_id, path) WHERE kind = 'file') WHERE rank <= 40)"


def _drawn(spark, sf_dir):
    return cut(graph.drawn_files(_trade(spark, sf_dir)[0], _scored(spark, sf_dir)), "drawn")


@query(f"WITH {T},{SCORED},{_DRAWN} SELECT node_id, path, region, rank FROM drawn")
def drill_top40(spark, sf_dir):
    return graph.drawn_files(_trade(spark, sf_dir)[0], _scored(spark, sf_dir))


@query(f"WITH {T},{SCORED},{_DRAWN} SELECT source, target FROM edges WHERE kind = 'imports' AND source <> target AND source IN (SELECT node_id FROM drawn) AND target IN (SELECT node_id FROM drawn)")
def induced_imports(spark, sf_dir):
    return graph.induced(_trade(spark, sf_dir)[1], _drawn(spark, sf_dir))


@query(f"""WITH {T},{SCORED},{_DRAWN}, i AS (SELECT source, target FROM edges WHERE kind = 'imports' AND source IN (SELECT node_id FROM drawn) AND target IN (SELECT node_id FROM drawn))
SELECT node_id, region FROM drawn WHERE node_id NOT IN (SELECT source FROM i UNION SELECT target FROM i)""")
def standalone(spark, sf_dir):
    return graph.standalone(_drawn(spark, sf_dir), _trade(spark, sf_dir)[1])


@query(f"WITH {T},{SCORED},{_DRAWN},{RADIUS} SELECT DISTINCT layer AS region FROM nodes WHERE kind = 'file' AND node_id IN (SELECT node_id FROM near UNION SELECT node_id FROM hit) AND node_id NOT IN (SELECT node_id FROM drawn)")
def regions_hiding(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    wanted = overlay.overlay(nodes, edges, _changed(spark, sf_dir))
    return graph.regions_hiding(nodes, _drawn(spark, sf_dir), wanted)


@query(f"""WITH {T},{SCORED},{_TOP}, b AS (SELECT source AS node_id, target AS other, kind, 'uses' AS direction FROM edges UNION ALL SELECT target, source, kind, 'used by' FROM edges)
SELECT b.node_id, other, n.name AS other_name, b.kind, direction FROM b JOIN nodes n ON n.node_id = other WHERE b.node_id IN (SELECT * FROM top)""")
def touching_edges(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return graph.touching(nodes, edges, _top(spark, sf_dir))


@query(f"""WITH RECURSIVE {C}, b AS (SELECT source AS a, target AS b FROM calls UNION SELECT target, source FROM calls),
w(node_id, depth) AS (SELECT 'region:0', 0 UNION SELECT b.b, depth + 1 FROM w JOIN b ON b.a = w.node_id WHERE depth < 6)
SELECT node_id, min(depth)::INT AS depth FROM w GROUP BY 1""")
def distances(spark, sf_dir):
    start = spark.createDataFrame([("region:0",)], "node_id string")
    return graph.distances(bindings.chain(spark, sf_dir), start)


@query(f"""WITH RECURSIVE {C}, w(node_id, depth) AS (SELECT DISTINCT source, 0 FROM calls WHERE source NOT IN (SELECT target FROM calls)
 UNION SELECT target, depth + 1 FROM w JOIN calls ON source = node_id) SELECT node_id, max(depth)::INT AS depth FROM w GROUP BY 1""")
def dependency_depth(spark, sf_dir):
    return graph.dependency_depth(bindings.chain(spark, sf_dir))


@query(f"""WITH RECURSIVE {C}, w(node_id, depth) AS (SELECT DISTINCT source, 0 FROM calls WHERE source NOT IN (SELECT target FROM calls)
 UNION SELECT target, depth + 1 FROM w JOIN calls ON source = node_id), d AS (SELECT node_id, max(depth)::INT AS depth FROM w GROUP BY 1)
SELECT depth, count(*)::BIGINT AS n_nodes, (dense_rank() OVER (ORDER BY depth) - 1)::INT AS band FROM d GROUP BY 1""")
def depth_bands(spark, sf_dir):
    return graph.bands(graph.dependency_depth(bindings.chain(spark, sf_dir)))


@query(f"""WITH {C}, e AS (SELECT min(substr(target, 7)::BIGINT) AS lo, max(substr(target, 7)::BIGINT) AS hi FROM calls WHERE target LIKE 'order:%'),
l AS (SELECT x.target AS o, x.source AS c, y.source AS n, z.source AS r FROM calls x JOIN calls y ON y.target = x.source JOIN calls z ON z.target = y.source WHERE x.target LIKE 'order:%'),
a AS (SELECT l.* FROM l, e WHERE l.o = 'order:' || lo), b AS (SELECT l.* FROM l, e WHERE l.o = 'order:' || hi),
w AS (SELECT CASE WHEN a.c = b.c THEN [a.o, a.c, b.o] WHEN a.n = b.n THEN [a.o, a.c, a.n, b.c, b.o] WHEN a.r = b.r THEN [a.o, a.c, a.n, a.r, b.n, b.c, b.o] ELSE [a.o, a.c, a.n, a.r, 'world:0', b.r, b.n, b.c, b.o] END AS way FROM a, b)
SELECT (unnest(range(len(way))))::INT AS pos, unnest(way) AS node_id FROM w""")
def shortest_path(spark, sf_dir):
    calls = bindings.chain(spark, sf_dir)
    ends = table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).head()
    nodes = calls.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    edges = calls.select("source", "target", F.xxhash64("source", "target").alias("edge_seq"))
    return graph.shortest_path(nodes, edges, f"order:{ends['a']}", f"order:{ends['b']}")


_MOST_LEVELS = 8
_BOUGHT = """e AS (SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, o_orderkey AS seq FROM orders
 UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 1000000000000 + l_orderkey * 1000000 + l_partkey FROM lineitem),
adj AS (SELECT source AS a, target AS b, seq FROM e UNION ALL SELECT target, source, seq FROM e),
ends AS (SELECT 'customer:' || min(o_custkey) AS a, 'customer:' || max(o_custkey) AS b FROM orders)"""


def _levels_sql() -> str:
    """Breadth-first levels of ``adj`` from one end: each node with the parent that found it first, and its place."""
    parts = ["v0 AS (SELECT a AS node, NULL::VARCHAR AS parent, 0::BIGINT AS ord FROM ends)"]
    for k in range(1, _MOST_LEVELS + 1):
        seen = f"SELECT node FROM v{k - 1}" + (f" UNION ALL SELECT node FROM v{k - 2}" if k > 1 else "")
        parts.append(f"""v{k} AS (SELECT node, parent, row_number() OVER (ORDER BY o, seq, parent, node) - 1 AS ord FROM (
 SELECT b AS node, a AS parent, ord AS o, seq FROM v{k - 1} JOIN adj ON adj.a = v{k - 1}.node WHERE b NOT IN ({seen})
 QUALIFY row_number() OVER (PARTITION BY b ORDER BY ord, seq, a) = 1))""")
    ways = []
    for k in range(1, _MOST_LEVELS + 1):
        joined = f"v{k} x{k} " + " ".join(f"JOIN v{j} x{j} ON x{j}.node = x{j + 1}.parent" for j in reversed(range(k)))
        ways.append(f"SELECT [{', '.join(f'x{j}.node' for j in range(k + 1))}] AS way FROM {joined} WHERE x{k}.node = (SELECT b FROM ends)")
    return ", ".join(parts) + ", w AS (" + " UNION ALL ".join(ways) + ")"


@query(f"WITH {_BOUGHT}, {_levels_sql()} SELECT (unnest(range(len(way))))::INT AS pos, unnest(way) AS node_id FROM w")
def tied_path(spark, sf_dir):
    """From the first customer to the last over orders and parts they share, where many ways are of one length."""
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), key)
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    bought = orders.select(name("customer", "o_custkey").alias("source"), name("order", "o_orderkey").alias("target"), F.col("o_orderkey").alias("edge_seq"))
    parts = lines.select(name("order", "l_orderkey").alias("source"), name("part", "l_partkey").alias("target"), (F.lit(10**12) + F.col("l_orderkey") * 10**6 + F.col("l_partkey")).alias("edge_seq"))
    edges = bought.unionByName(parts)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    ends = orders.agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b")).head()
    return graph.shortest_path(nodes, edges, f"customer:{ends['a']}", f"customer:{ends['b']}")


# --- retrieval ----------------------------------------------------------------------

QUESTION = "How does the tion handle the Src3 into?"
_TERMS_SQL = "['handle', 'src3', 'tion']"
_CLAMPED = "CASE WHEN length(summary) > 400 THEN substr(summary, 1, 400) || '…' ELSE summary END"
_SCORES = f"""sc AS (SELECT node_id, kind, list_sum(list_transform({_TERMS_SQL}, lambda t: CASE WHEN contains(lower(name), t) THEN 3 WHEN contains(lower(path), t) THEN 2
 WHEN contains(lower({_CLAMPED}), t) THEN 1 ELSE 0 END))::INT AS score FROM docs)"""


_HIT = "contains(lower(name), needle) OR contains(lower(path), needle) OR contains(lower(summary), needle)"
#: One that names hold, one that paths hold, one of texts, and one that nothing holds.
NEEDLES = ("D12", " eN/SRC3 ", "  TioN ", "no such words here, at all")


@query(f"WITH {D}, n AS (SELECT lower(trim(unnest({list(NEEDLES)}))) AS needle) SELECT needle, node_id, name FROM docs, n WHERE {_HIT}")
def search(spark, sf_dir):
    docs = bindings.documents(spark, sf_dir)
    found = [retrieval.search(docs, n).select(F.lit(n.strip().lower()).alias("needle"), "node_id", "name") for n in NEEDLES]
    return reduce(DataFrame.unionByName, found)


#: Beside these, needles of one and two letters, some beyond ASCII, and a blank one.
MORE_NEEDLES = (*NEEDLES, "q", " Z", "é", "ch", "ße", "…", "…x", "d1", ".md", "", " ", "en/src3/d7.md", "the of")


@query(f"WITH {D}, n AS (SELECT DISTINCT lower(trim(unnest({list(MORE_NEEDLES)}))) AS needle) SELECT needle, node_id, name FROM docs, n WHERE needle <> '' AND ({_HIT})")
def indexed_search(spark, sf_dir):
    """A table of needles, answered by the trigram index."""
    index = trigrams.build(bindings.documents(spark, sf_dir))
    words = spark.createDataFrame([(n.strip().lower(),) for n in MORE_NEEDLES], "word string")
    hits = trigrams.found(index, words).select("word", "number").distinct()
    return hits.join(index.nodes, "number").select(F.col("word").alias("needle"), "node_id", "name")


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOPWORDS)


@query(rf"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'),
 lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))), ' ') AS terms FROM benchmark""")
def terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(retrieval.terms(F.col("text")), " ").alias("terms"))


@query(f"WITH {D},{_SCORES} SELECT node_id, kind, score FROM sc")
def term_score(spark, sf_dir):
    return retrieval.scored_nodes(bindings.documents(spark, sf_dir), QUESTION)


@query(f"""WITH {D},{_SCORES}, ci AS (SELECT node_id, min(doc_id) AS cite_rank FROM docs JOIN (SELECT doc_id, 'd' || doc_id || '.md' AS name FROM labels WHERE toxic = 1 AND quality = 0) USING (name) GROUP BY 1)
SELECT (row_number() OVER (ORDER BY cite_rank NULLS LAST, score DESC, node_id))::INT AS rank, node_id, score FROM sc LEFT JOIN ci USING (node_id) ORDER BY rank LIMIT 40""")
def context_slice(spark, sf_dir):
    docs = bindings.documents(spark, sf_dir)
    cited = table(spark, sf_dir, "labels").where("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("cite_rank"), F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("name"))
    return retrieval.context_slice(docs, QUESTION, cited.join(docs.select("name", "node_id"), "name"))


@query(rf"""WITH {D}, q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))) AS t FROM benchmark),
f AS (SELECT node_id, lower(name) AS n, lower(path) AS p, lower({_CLAMPED}) AS s FROM docs),
h AS (SELECT t, node_id, CASE WHEN contains(n, t) THEN 3 WHEN contains(p, t) THEN 2 WHEN contains(s, t) THEN 1 ELSE 0 END AS c FROM (SELECT DISTINCT t FROM q) JOIN f ON contains(n, t) OR contains(p, t) OR contains(s, t)),
sc AS (SELECT item_id, node_id, sum(c) AS score FROM q JOIN h USING (t) GROUP BY 1, 2),
every AS (SELECT b.item_id, d.node_id, coalesce(score, 0)::INT AS score FROM benchmark b CROSS JOIN docs d LEFT JOIN sc ON sc.item_id = b.item_id AND sc.node_id = d.node_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, node_id))::INT AS rank FROM every)
SELECT item_id, rank, node_id, score FROM r WHERE rank <= 40""")
def question_slices(spark, sf_dir):
    """The context slice of every row of ``benchmark`` at once."""
    index = trigrams.build(bindings.documents(spark, sf_dir))
    return trigrams.slices(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("""WITH w AS (SELECT conv_id, turn, role, text AS question, lead(role) OVER c AS nr, lead(text) OVER c AS answer FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM w WHERE role = 'user' AND nr = 'assistant'),
d AS (SELECT conv_id, string_agg(turn || ':' || length(CASE WHEN length(question) > 1000 THEN substr(question, 1, 1000) || '…' ELSE question END) || ':' || length(CASE WHEN length(answer) > 2000 THEN substr(answer, 1, 2000) || '…' ELSE answer END), ',' ORDER BY turn) AS turns FROM t WHERE k <= 6 GROUP BY 1),
l AS (SELECT conv_id, arg_max(role, turn) = 'user' AS in_flight FROM conversations GROUP BY 1)
SELECT conv_id, coalesce(turns, '') AS turns, in_flight FROM l LEFT JOIN d USING (conv_id)""")
def turn_carry(spark, sf_dir):
    """The newest exchanges of each conversation as turn, length of question and of answer."""
    told = retrieval.carried(table(spark, sf_dir, "conversations"))
    shown = F.transform("turns", lambda t: F.concat_ws(":", t["turn"].cast("string"), F.length(t["question"]).cast("string"), F.length(t["answer"]).cast("string")))
    return told.select("conv_id", F.array_join(shown, ",").alias("turns"), "in_flight")


_TURNS = """w AS (SELECT conv_id, turn, role, text AS question, lead(role) OVER c AS nr, lead(text) OVER c AS answer FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
tn AS (SELECT conv_id, turn, question, answer FROM w WHERE role = 'user' AND nr = 'assistant')"""


@query(f"""WITH {_TURNS} SELECT conv_id, turn, CASE WHEN length(question) > 1000 THEN substr(question, 1, 1000) || '…' ELSE question END AS question,
 CASE WHEN length(answer) > 2000 THEN substr(answer, 1, 2000) || '…' ELSE answer END AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM tn) WHERE r <= 6""")
def turn_clamp(spark, sf_dir):
    return retrieval.clamped_turns(retrieval.turns(table(spark, sf_dir, "conversations")))


@query(f"""WITH {_TURNS} SELECT conv_id, turn, array_to_string(list_transform(string_split(answer, ' ')[:40], lambda x: CASE WHEN length(x) > 500 THEN substr(x, 1, 500) || '…' ELSE x END), '|') AS citations
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM tn) WHERE r <= 6""")
def turn_citations(spark, sf_dir):
    talk = retrieval.turns(table(spark, sf_dir, "conversations")).withColumn("citations", F.split("answer", " "))
    return retrieval.clamped_turns(talk).select("conv_id", "turn", F.array_join("citations", "|").alias("citations"))


@query(f"WITH {_TURNS} SELECT conv_id, sum(length(question))::BIGINT AS input_tokens, sum(length(answer))::BIGINT AS output_tokens FROM tn GROUP BY 1 HAVING count(*) > 1 AND count(*) = count(question) AND count(*) = count(answer)")
def usage_total(spark, sf_dir):
    talk = retrieval.turns(table(spark, sf_dir, "conversations"))
    measured = talk.select("conv_id", F.length("question").cast("long").alias("input_tokens"), F.length("answer").cast("long").alias("output_tokens"))
    return retrieval.usage_total(measured)


@query(r"""SELECT item_id, CASE WHEN trim(coalesce(text, ''), E' \t\n\r\x0b\x0c') = '' THEN 'the question is empty'
 WHEN length(trim(text, E' \t\n\r\x0b\x0c')) > 1000 THEN 'the question is ' || length(trim(text, E' \t\n\r\x0b\x0c')) || ' characters; the limit is 1000' ELSE 'ok' END AS status FROM benchmark""")
def question_check(spark, sf_dir):
    return retrieval.validated(table(spark, sf_dir, "benchmark"))


@query(f"""WITH {D} SELECT d.node_id, min(l.doc_id)::BIGINT AS pos FROM (SELECT doc_id, 'd' || doc_id || '.md' AS name FROM labels) l JOIN docs d USING (name) GROUP BY 1""")
def citation_verify(spark, sf_dir):
    docs = bindings.documents(spark, sf_dir).select("node_id", "name")
    cites = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("name"))
    return retrieval.verified(cites.join(docs, "name", "left").select("pos", "node_id"), docs)


def _list_sql(a: str) -> str:
    return f"CASE WHEN len({a}) > 3 THEN array_to_string({a}[:3], ', ') || ', and ' || (len({a}) - 3) || ' more' WHEN len({a}) <= 1 THEN {a}[1] ELSE array_to_string({a}[:len({a}) - 1], ', ') || ' and ' || {a}[len({a})] END"


@query(f"""WITH {T}, pr AS (SELECT target AS node_id, source AS other, kind, 'i' AS way FROM edges WHERE kind IN ('imports', 'calls')
 UNION ALL SELECT source, target, kind, 'o' FROM edges WHERE kind IN ('imports', 'calls') UNION ALL SELECT source, target, kind, 'h' FROM edges WHERE kind = 'contains'),
nm AS (SELECT pr.node_id, way, name, min((CASE pr.kind WHEN 'imports' THEN '0' ELSE '1' END) || other) AS seq FROM pr JOIN nodes n ON n.node_id = other GROUP BY 1, 2, 3),
li AS (SELECT node_id, list(name ORDER BY seq, name) FILTER (way = 'h') AS h, list(name ORDER BY seq, name) FILTER (way = 'i') AS i, list(name ORDER BY seq, name) FILTER (way = 'o') AS o FROM nm GROUP BY 1)
SELECT f.node_id, concat_ws(' ', CASE WHEN len(h) > 0 THEN 'Holds ' || len(h) || CASE len(h) WHEN 1 THEN ' definition: ' ELSE ' definitions: ' END || {_list_sql('h')} || '.' END,
 CASE WHEN i IS NULL AND o IS NULL THEN 'Nothing in this map reaches it, and it reaches nothing.' ELSE
  concat_ws(' ', CASE WHEN i IS NULL THEN 'Nothing in this map reaches it, so it is a way in.' ELSE 'Reached by ' || {_list_sql('i')} || '.' END,
   CASE WHEN o IS NULL THEN 'It reaches nothing further — the walk ends here.' ELSE 'It reaches ' || {_list_sql('o')} || '.' END) END) AS narrative
FROM nodes f LEFT JOIN li USING (node_id) WHERE f.kind = 'file'""")
def narrative(spark, sf_dir):
    return retrieval.narratives(*_trade(spark, sf_dir))


# --- annotation ---------------------------------------------------------------------

SLOTS = f"""{SCORED},{TOUR},{LAYERS},{STEPS[len(ENTRY) + 1 :]},
slots AS (SELECT 'summary:' || node_id AS slot_key, 0 AS family, summary AS payload FROM nodes
 UNION ALL SELECT 'layer-name:' || layer_id, 1, name FROM layers UNION ALL SELECT 'layer-description:' || layer_id, 2, description FROM layers
 UNION ALL SELECT 'flow-name:' || flow_id, 3, name FROM flows UNION ALL SELECT 'tour-label:' || node_id, 4, label FROM tour)"""


def _slots(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    flows = semantics.flows(nodes, semantics.rooted_steps(nodes, edges, named=True))
    return annotate.slots(nodes, semantics.layers(nodes), flows, semantics.tour(semantics.contenders(nodes, edges)))


@query(f"WITH {T},{SLOTS} SELECT slot_key, family, payload FROM slots")
def slots(spark, sf_dir):
    return _slots(spark, sf_dir)


@query(f"""WITH {T},{SLOTS}, lf AS (SELECT layer_id, (SELECT count(*) FROM nodes WHERE kind = 'file' AND layer = layer_id) AS n FROM layers),
fl AS (SELECT f.flow_id, f.domain, f.n_steps, list(n.name ORDER BY p.pos) FILTER (p.pos < 10) AS names FROM flows f JOIN pos p USING (root) JOIN nodes n ON n.node_id = p.node_id GROUP BY ALL)
SELECT 'summary:' || node_id AS slot_key, 0::INT AS family, json_object('slot', 'summary', 'key', 'summary:' || node_id, 'kind', kind, 'name', name, 'path', path, 'mechanical_summary', summary)::VARCHAR AS payload FROM nodes
UNION ALL SELECT k || ':' || layer_id, i, json_object('slot', k, 'key', k || ':' || layer_id, 'directory', layer_id, 'member_files', n)::VARCHAR FROM lf, (VALUES ('layer-name', 1), ('layer-description', 2)) v(k, i)
UNION ALL SELECT 'flow-name:' || flow_id, 3, json_object('slot', 'flow-name', 'key', 'flow-name:' || flow_id, 'domain', domain, 'entry_point', names[1], 'steps', names, 'step_count', n_steps)::VARCHAR FROM fl
UNION ALL SELECT 'tour-label:' || t.node_id, 4, json_object('slot', 'tour-label', 'key', 'tour-label:' || t.node_id, 'path', path, 'fan_in', fan_in, 'fan_out', fan_out, 'mechanical_label', label)::VARCHAR FROM tour t JOIN sig USING (node_id)""")
def slot_payloads(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    scored, steps = semantics.contenders(nodes, edges), semantics.rooted_steps(nodes, edges, named=True)
    return annotate.slot_payloads(nodes, semantics.layers(nodes), semantics.flows(nodes, steps), steps, semantics.tour(scored), scored)


@query(f"WITH {T},{SLOTS} SELECT slot_key, floor((row_number() OVER (ORDER BY family, slot_key) - 1) / 25)::BIGINT AS batch_id FROM slots")
def batches(spark, sf_dir):
    return annotate.batches(_slots(spark, sf_dir))


@query(f"""WITH {T},{SLOTS}, a AS (SELECT count(*) AS n, sum(length(payload) + length(slot_key)) AS c FROM slots)
SELECT n::BIGINT AS n_slots, ceil(n / 25)::BIGINT AS n_calls, floor(c / 4)::BIGINT AS prompt_low, floor(c / 3)::BIGINT AS prompt_high, (n * 25)::BIGINT AS answer_low, (n * 45)::BIGINT AS answer_high FROM a""")
def cost_estimate(spark, sf_dir):
    return annotate.cost_estimate(_slots(spark, sf_dir))


@query("""SELECT 'd' || d.doc_id AS key, CASE WHEN l.quality = 1 THEN 'kept ' || l.doc_id ELSE d.source END AS text, CASE WHEN l.quality = 1 THEN 'llm' ELSE 'structural' END AS provenance
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def reattach(spark, sf_dir):
    key = lambda c: F.concat(F.lit("d"), c).alias("key")
    docs = table(spark, sf_dir, "documents")
    now = docs.select(key("doc_id"), annotate.content_hash(F.col("text")).alias("hash"), F.col("source").alias("text"))
    then = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    hashed = F.when(F.col("quality") == 1, annotate.content_hash(F.col("text"))).otherwise(F.lit("stale"))
    return annotate.reattach(now, then.select(key("doc_id"), hashed.alias("hash"), F.concat(F.lit("kept "), "doc_id").alias("text")))


@query("""SELECT 'd' || d.doc_id AS slot_key, CASE WHEN l.toxic = 0 THEN ' clean ' ELSE d.source END AS text, CASE WHEN l.toxic = 0 THEN 'llm' ELSE 'structural' END AS provenance
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def apply_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("slot_key"), F.col("source").alias("payload"))
    said = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("slot_key"), F.when(F.col("toxic") == 0, " clean ").otherwise("  ").alias("answer"))
    return annotate.apply_answers(docs, said)


#: FNV-1a as a fold over bytes, in DuckDB: of column ``t``.
_FNV = """'fnv1a64:' || lpad(lower(to_hex((list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(1, octet_length(encode(t)) + 1),
 lambda j: ('0x' || substr(hex(encode(t)), 2 * j - 1, 2))::UBIGINT)),
 lambda h, b: ((xor(h, b)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT)))), 16, '0')"""


@query(f"SELECT doc_id, {_FNV} AS content_hash FROM (SELECT doc_id, text AS t FROM documents)")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", annotate.content_hash(F.col("text")).alias("content_hash"))


@query(f"""WITH {T}, m AS (SELECT layer AS key, string_agg(path, chr(10) ORDER BY path) AS t FROM nodes WHERE kind = 'file' GROUP BY 1) SELECT key AS layer_id, {_FNV} AS hash FROM m""")
def layer_hashes(spark, sf_dir):
    return annotate.layer_inputs(_trade(spark, sf_dir)[0])


@query(f"""WITH {T},{STEPS}, m AS (SELECT root AS key, string_agg(node_id, chr(10) ORDER BY pos) AS t FROM pos GROUP BY 1) SELECT key AS root, {_FNV} AS hash FROM m""")
def flow_hashes(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return annotate.flow_inputs(semantics.flow_steps(nodes, edges))


@query(f"""WITH {T},{SCORED},{TOUR}, m AS (SELECT node_id, label AS t FROM tour) SELECT node_id, {_FNV} AS hash FROM m""")
def tour_hashes(spark, sf_dir):
    return annotate.tour_inputs(semantics.tour(_contenders(spark, sf_dir)))


# --- redaction ----------------------------------------------------------------------

_ENRICHED = """
enr AS (SELECT n.* REPLACE (CASE WHEN l.quality = 1 THEN 'llm' WHEN l.quality = 0 THEN NULL ELSE 'structural' END AS provenance), 'x' AS secret FROM
 (SELECT *, NULL AS layer, 'structural' AS provenance FROM docs) n LEFT JOIN labels l ON n.name = 'd' || l.doc_id || '.md')"""


def _enriched(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("name"), "quality")
    docs = bindings.documents(spark, sf_dir).drop("layer").join(marks, "name", "left")
    provenance = F.when(F.col("quality") == 1, "llm").when(F.col("quality") == 0, F.lit(None)).otherwise("structural")
    return docs.withColumn("provenance", provenance).withColumn("secret", F.lit("x")).drop("quality")


@query(f"WITH {D},{_ENRICHED} SELECT node_id, kind, path, provenance, name, CASE WHEN provenance = 'structural' THEN summary ELSE '[redacted]' END AS summary FROM enr")
def redacted_nodes(spark, sf_dir):
    return redact.redacted(_enriched(spark, sf_dir), "nodes")


@query(f"WITH {D},{_ENRICHED} SELECT 'nodes.summary' AS field, count(*) FILTER (provenance IS DISTINCT FROM 'structural')::BIGINT AS n FROM enr UNION ALL SELECT 'nodes.secret', count(*)::BIGINT FROM enr")
def redaction_counts(spark, sf_dir):
    return redact.disclosure(_enriched(spark, sf_dir), "nodes")


# --- extraction and resolution --------------------------------------------------------

_SYM = "sym AS (SELECT p_brand AS path, p_partkey AS seq, 'function' AS kind, split_part(p_type, ' ', 1) AS name FROM part)"


def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("path"), F.col("p_partkey").alias("seq"), F.lit("function").alias("kind"), F.split("p_type", " ")[0].alias("name"))


@query(f"WITH {_SYM}, r AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY seq) AS k FROM sym) SELECT path, seq, kind, name, CASE WHEN k > 1 THEN name || '#' || k ELSE name END AS symbol FROM r")
def symbol_ordinals(spark, sf_dir):
    return extract.symbol_ids(_symbols(spark, sf_dir))


@query(r"""WITH l AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + (text <> '' AND NOT text LIKE '%' || chr(10))::INT AS n FROM documents)
SELECT doc_id, 'Markdown file, ' || n || CASE n WHEN 1 THEN ' line' ELSE ' lines' END AS summary FROM l""")
def file_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    zero = F.lit(0)
    return docs.select("doc_id", extract.file_summary(F.lit("Markdown"), extract.line_count(F.col("text")), zero, zero).alias("summary"))


_LINKED = """lk AS (SELECT lang || '/' || source || '/d' || doc_id || '.md' AS path, coalesce(text, '') || chr(10) ||
 'See [the next](../src' || ((doc_id + 1) % 20) || '/d' || (doc_id + 1) || '.md#top "t") and [x](https://e.org/a).' || chr(10) || '```' || chr(10) || '[no](no.md)' || chr(10) || '```' || chr(10) || '[r]: <./d' || doc_id || '.md?q>' AS text FROM documents)"""


def _linked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/d"), "doc_id", F.lit(".md"))
    after = F.col("doc_id") + 1
    text = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\nSee [the next](../src"), after % 20, F.lit("/d"), after, F.lit('.md#top "t") and [x](https://e.org/a).\n```\n[no](no.md)\n```\n[r]: <./d'),
        "doc_id", F.lit(".md?q>"))
    return docs.select(path.alias("path"), text.alias("text"))


@query(f"""WITH {_LINKED}, ln AS (SELECT path, regexp_extract(text, '\\]\\(([^)#\\s]+)', 1) AS a, regexp_extract(text, ': <([^?>]+)', 1) AS b FROM lk)
SELECT path, 0 AS pos, a AS target FROM ln UNION ALL SELECT path, 2, b FROM ln""")
def markdown_links(spark, sf_dir):
    return extract.markdown_links(_linked(spark, sf_dir))


@query(f"""WITH {_LINKED}, ln AS (SELECT path, regexp_extract(text, '\\]\\(([^)#\\s]+)', 1) AS a, regexp_extract(text, ': <([^?>]+)', 1) AS b FROM lk),
t AS (SELECT path, 0 AS import_seq, split_part(path, '/', 1) || substr(a, 3) AS target FROM ln WHERE a LIKE '../%' UNION ALL SELECT path, 2, regexp_replace(path, '/[^/]*$', '') || substr(b, 2) FROM ln WHERE b LIKE './%')
SELECT path, import_seq, target FROM t WHERE target IN (SELECT path FROM lk)""")
def md_import_edges(spark, sf_dir):
    links = extract.markdown_links(_linked(spark, sf_dir)).withColumnRenamed("pos", "import_seq")
    paths = bindings.documents(spark, sf_dir).select("path")
    return resolve.first_match(links, resolve.markdown_candidates(F.col("path"), F.col("target")), paths)


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages) SELECT page_id, (unnest(range(len(a))))::INT AS pos, unnest(a) AS href FROM h""")
def page_links(spark, sf_dir):
    return extract.hrefs(table(spark, sf_dir, "pages"))


@query(f"""WITH {T}, f AS (SELECT path FROM nodes WHERE kind = 'file'),
i AS (SELECT c_custkey AS import_seq, c_path AS path, '../../supplier/' || n_name || '/./s' || (c_custkey % 50) || '.js' AS specifier FROM (SELECT c.*, cu.c_nationkey FROM c JOIN customer cu USING (c_custkey)) JOIN nation ON n_nationkey = c_nationkey)
SELECT i.path, import_seq, f.path AS target FROM i JOIN f ON f.path = regexp_replace(replace(replace(specifier, '../../', ''), '/./', '/'), '.js$', '.ts')""")
def es_imports(spark, sf_dir):
    paths = _trade(spark, sf_dir)[0].where("kind = 'file'").select("path")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    spec = F.concat(F.lit("../../supplier/"), "n_name", F.lit("/./s"), F.col("c_custkey") % 50, F.lit(".js"))
    path = F.concat(F.lit("customer/"), "c_mktsegment", F.lit("/c"), "c_custkey", F.lit(".go"))
    rows = c.select(path.alias("path"), F.col("c_custkey").alias("import_seq"), spec.alias("specifier"))
    return resolve.first_match(rows, resolve.es_candidates(F.col("path"), F.col("specifier")), paths)


@query(f"WITH {T}, g AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM nodes WHERE kind = 'file' AND path LIKE '%.go') SELECT dir, min(path) AS anchor FROM g GROUP BY 1")
def package_anchors(spark, sf_dir):
    return resolve.package_anchors(_trade(spark, sf_dir)[0].where("kind = 'file'").select("path"))


# --- more views ---------------------------------------------------------------------


@query(f"WITH {T},{ENTRY} SELECT (row_number() OVER (ORDER BY path, node_id))::INT AS rank, node_id FROM ent ORDER BY rank LIMIT 6")
def entry_functions(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return regions.entry_points(nodes, semantics.entry_functions(nodes, edges))


@query(f"WITH {T} SELECT s.node_id, f.node_id AS file_id FROM nodes s JOIN nodes f USING (path) WHERE s.kind <> 'file' AND f.kind = 'file'")
def symbol_files(spark, sf_dir):
    return regions.symbol_files(_trade(spark, sf_dir)[0])


@query(f"WITH {D},{_ENRICHED}, {T},{LAYERS} SELECT ((SELECT count(*) FROM enr WHERE provenance = 'llm'))::BIGINT AS n_enriched, ((SELECT count(*) FROM enr) + (SELECT count(*) FROM layers))::BIGINT AS n_slots")
def enriched_slots(spark, sf_dir):
    return regions.enriched_slots(_enriched(spark, sf_dir), semantics.layers(_trade(spark, sf_dir)[0]))


@query("""SELECT i.doc_id AS pos, 'file:' || i.doc_id AS node_id, CASE WHEN d.doc_id IS NOT NULL THEN d.source END AS name, d.doc_id IS NULL AS missing
FROM labels i LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON d.doc_id = i.doc_id""")
def citation_missing(spark, sf_dir):
    node = lambda c: F.concat(F.lit("file:"), c).alias("node_id")
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(node("doc_id"), F.col("source").alias("name"))
    return retrieval.cited_nodes(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), node("doc_id")), docs)


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), x AS (SELECT doc_id, (unnest(range(1, len(a) + 1)))::INT AS line, unnest(a) AS text FROM l) SELECT *, line BETWEEN 2 AND 3 AS lit FROM x")
def source_lines(spark, sf_dir):
    return retrieval.source_lines(table(spark, sf_dir, "documents"), "doc_id", 2, 3)


_FACTS = """
fn AS (SELECT DISTINCT 'lib/' || p_brand || '.ts' AS path, 'f' || p_size AS name, p_size % 2 = 0 AS exported FROM part
  UNION ALL SELECT 'app/c' || c_custkey || '.ts', 'main', true FROM customer UNION ALL SELECT 'app/c' || c_custkey || '.ts', 'f' || (c_custkey % 50), false FROM customer),
own AS (SELECT path, name FROM fn WHERE exported),
re AS (SELECT DISTINCT 'lib/' || p_brand || '.ts' AS path, 'f' || p_size AS name FROM part WHERE p_size % 7 = 0),
ex AS (SELECT path, name, path AS dp, name AS dn FROM own UNION ALL SELECT path, name, path, 'f2' FROM re
  WHERE (path, name) NOT IN (SELECT (path, name) FROM own) AND path IN (SELECT path FROM own WHERE name = 'f2')),
use AS (SELECT DISTINCT 'app/c' || o_custkey || '.ts' AS path, 'f' || p_size AS callee, 'lib/' || p_brand || '.ts' AS target, p_partkey AS ord
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
loc AS (SELECT DISTINCT path, callee, path AS dp, callee AS dn FROM use WHERE (path, callee) IN (SELECT (path, name) FROM fn)),
bnd AS (SELECT u.path, callee, arg_max(dp, ord) AS dp, arg_max(dn, ord) AS dn FROM use u JOIN ex ON ex.path = u.target AND ex.name = u.callee
  WHERE (u.path, callee) NOT IN (SELECT (path, name) FROM fn) GROUP BY 1, 2)"""


@query(f"""WITH {_FACTS} SELECT DISTINCT 'function:' || path || ':main' AS source, 'function:' || dp || ':' || dn AS target, 'calls' AS kind, 0.9::DOUBLE AS weight
FROM (SELECT path, dp, dn FROM loc UNION ALL SELECT path, dp, dn FROM bnd)""")
def call_edges(spark, sf_dir):
    """Customers' files call functions of the brands' files that their orders bring in."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    lib, size = F.concat(F.lit("lib/"), "p_brand", F.lit(".ts")), F.concat(F.lit("f"), "p_size")
    app = lambda c: F.concat(F.lit("app/c"), c, F.lit(".ts"))
    functions = part.select(lib.alias("path"), size.alias("name"), (F.col("p_size") % 2 == 0).alias("exported")).distinct()
    mains = customer.select(app("c_custkey").alias("path"), F.lit("main").alias("name"), F.lit(True).alias("exported"))
    helpers = customer.select(app("c_custkey").alias("path"), F.concat(F.lit("f"), F.col("c_custkey") % 50).alias("name"), F.lit(False).alias("exported"))
    again = part.where("p_size % 7 = 0").select(
        lib.alias("path"), F.col("p_size").alias("seq"), size.alias("exported"), F.lit("f2").alias("local"), F.lit(False).alias("has_specifier"), F.lit(None).cast("string").alias("target"))
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    used = bought.select(app("o_custkey").alias("path"), size.alias("callee"), lib.alias("target"), F.col("p_partkey").alias("ord")).distinct()
    made = used.select("path", F.lit("main").alias("caller"), "callee", F.lit("").alias("receiver"))
    bound = used.select("path", F.col("callee").alias("local"), F.col("callee").alias("imported"), "target", "ord")
    modules = spark.createDataFrame([], "path string, local string, target string, ord long")
    return calls.resolve_calls(made, functions.unionByName(mains).unionByName(helpers), again.distinct(), bound, modules)


# --- source files made of documents ---------------------------------------------------

#: Characters that would end a string or a comment, and what stands for them.
_UNSAFE = "\"`\\$*", "''/S+"
#: By the id's remainder: extension, text before and after the document's, lines before ``f`` and of ``f`` beside
#: the text's (which are in the one or the other), and how far below its end ``h`` stands. ``#`` is the id.
_SOURCES = (
    ("py", 'def f#(\n    a,\n    b=1,\n):\n    """', '\n    def ghost():\n        h#()\n    """\n    return h#(\n        a,\n    )\n\n\ndef h#(a): return a\n', 0, 11, True, 3, True),
    ("ts", "export function f#<T>(\n  a: T,\n): T {\n  const t = `", "\n function ghost() { h#() }`;\n  return h#(\n    a,\n  );\n}\n\nconst h# = (a) => a;\n", 0, 9, True, 2, False),
    ("go", "package p\n\nvar t = `", "\nfunc ghost() {\n\th#()\n}\n`\n\nfunc f#(\n\ta int,\n) int {\n\treturn h#(\n\t\ta,\n\t)\n}\n\nfunc h#(a int) int { return a }\n", 8, 7, False, 2, None),
    ("rs", "/* /* ", " */ fn ghost() { h#() } */\npub fn f#(\n    a: u8,\n) -> u8\nwhere\n    u8: Copy,\n{\n    h#(\n        a,\n    )\n}\n\nfn h#(a: u8) -> u8 { a }\n", 1, 10, False, 2, False),
    ("c", "/* ", "\nint ghost(int a) {\n  return h#(a);\n} */\nint f#(\n  int a)\n{\n  return h#(\n    a);\n}\n\nstatic int h#(int a) { return a; }\n", 4, 6, False, 2, False),
)


def _source_files(spark, sf_dir):
    """A source file for each document, its language by the id; the text is a string or a comment within."""
    docs = table(spark, sf_dir, "documents")
    text = F.translate(F.coalesce("text", F.lit("")), *_UNSAFE)
    path = body = F.lit(None).cast("string")
    for i, (extension, before, after, *_) in enumerate(_SOURCES):
        mine = F.col("doc_id") % len(_SOURCES) == i
        named = lambda s: F.replace(F.lit(s), F.lit("#"), F.col("doc_id").cast("string"))
        path = F.when(mine, F.concat(F.lit("src/d"), "doc_id", F.lit(f"/m.{extension}"))).otherwise(path)
        body = F.when(mine, F.concat(named(before), text, named(after))).otherwise(body)
    return docs.select(path.alias("path"), body.alias("text"))


def _source_symbols() -> str:
    """What each file's two functions are, from the lines of its text alone."""
    parts = []
    for i, (extension, _, _, before, lines, inside, gap, h_exported) in enumerate(_SOURCES):
        start, end = (f"{before + 1}", f"{before + lines} + n") if inside else (f"{before + 1} + n", f"{before + lines} + n")
        f_exported = "true" if h_exported is not None else "false"
        mine = f"FROM lined WHERE doc_id % {len(_SOURCES)} = {i}"
        path = f"'src/d' || doc_id || '/m.{extension}'"
        parts.append(f"SELECT {path} AS path, 'f' || doc_id AS name, {start} AS start_line, {end} AS end_line, {f_exported} AS exported {mine}")
        parts.append(f"SELECT {path}, 'h' || doc_id, {end} + {gap}, {end} + {gap}, {'true' if h_exported else 'false'} {mine}")
    return "lined AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), sym AS (" + " UNION ALL ".join(parts) + ")"


@query(f"WITH {_source_symbols()} SELECT path, name, start_line::INT AS start_line, end_line::INT AS end_line, exported FROM sym")
def source_symbols(spark, sf_dir):
    """Functions with heads of several lines, beside ghosts in comments and strings that hold whole documents."""
    found = repository.symbols(repository.facts(_source_files(spark, sf_dir)))
    return found.select("path", "name", "start_line", "end_line", "exported")


@query(f"""WITH {_source_symbols()} SELECT 'contains' AS kind, 'file:' || path AS source, 'function:' || path || ':' || name AS target FROM sym
UNION ALL SELECT 'exports', 'file:' || path, 'function:' || path || ':' || name FROM sym WHERE exported
UNION ALL SELECT 'calls', 'function:' || path || ':' || name, 'function:' || path || ':h' || substr(name, 2) FROM sym WHERE name LIKE 'f%'""")
def source_edges(spark, sf_dir):
    """The map of those files: each ``f`` calls its file's ``h``."""
    return repository.graph_of(_source_files(spark, sf_dir))[1].select("kind", "source", "target")


def _source_literals() -> str:
    """The one comment or string of each file, from its first to its last sign."""
    parts = []
    for i, ((extension, before, after, *_), (opening, closing)) in enumerate(zip(_SOURCES, (('"""', '"""'), ("`", "`"), ("`", "`"), ("/*", "*/"), ("/*", "*/")))):
        begin = before.index(opening)
        end = after.rindex(closing) + len(closing) if extension == "rs" else after.index(closing) + len(closing)
        said = lambda s: "replace('" + s.replace("'", "''") + "', '#', doc_id::VARCHAR)"
        start = f"length({said(before[:begin])})"
        length = f"length({said(before[begin:])}) + length(text) + length({said(after[:end])})"
        parts.append(f"SELECT 'src/d' || doc_id || '/m.{extension}' AS path, {start} AS start, {start} + {length} AS \"end\", "
                     f"'{'comment' if opening == '/*' else 'string'}' AS class FROM d WHERE doc_id % {len(_SOURCES)} = {i}")
    return "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), lit AS (" + " UNION ALL ".join(parts) + ")"


@query(f'WITH {_source_literals()} SELECT path, start::INT AS start, "end"::INT AS "end", class FROM lit')
def source_literals(spark, sf_dir):
    """The comments and strings among the tokens of those files."""
    return tokens.token_rows(_source_files(spark, sf_dir)).where("class IN ('comment', 'string')")
