"""Bindings of relational tables to the graph model.

``trade`` reads suppliers and parts as files that import each other through
line items, customers as files that contain their orders as functions, and
orders as functions that call the parts' functions. ``chain`` reads regions,
nations, customers and orders as a forest of calls. ``documents`` has a file
for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import edge, node_id, top_directory
from graphloom.session import table


def _node(kind: str, name, path, summary, symbol=None) -> list:
    return [
        node_id(kind, path, symbol).alias("node_id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"),
        summary.alias("summary"), (top_directory(path) if kind == "file" else F.lit(None).cast("string")).alias("layer"),
        F.lit("structural").alias("provenance"),
    ]


def _supplier_path(key, nation):
    return F.concat(F.lit("supplier/"), nation, F.lit("/s"), key, F.lit(".ts"))


def _part_path(key, brand):
    return F.concat(F.lit("part/"), brand, F.lit("/p"), key, F.lit(".py"))


def _customer_path(key, segment):
    return F.concat(F.lit("customer/"), segment, F.lit("/c"), key, F.lit(".go"))


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the trade graph.

    Lines are joined by their keys and with what their ends' ids are made of; the ids themselves
    are made from the joined rows, so that no shuffle carries them. Lines are dealt out once for a
    key, by which they are made distinct and joined.
    """
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", "n_name")
    supplier = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = t("part").select("p_partkey", "p_name", "p_brand")
    customer = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(customer.drop("c_name"), F.col("o_custkey") == F.col("c_custkey"))
    s_path, p_path = _supplier_path(F.col("s_suppkey"), F.col("n_name")), _part_path(F.col("p_partkey"), F.col("p_brand"))
    c_path = _customer_path(F.col("c_custkey"), F.col("c_mktsegment"))
    make, order = F.concat(F.lit("make"), "p_partkey"), F.concat(F.lit("order"), "o_orderkey")
    nodes = (
        supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(*_node("file", F.concat(F.lit("s"), "s_suppkey", F.lit(".ts")), s_path, F.col("s_name")))
        .unionByName(part.select(*_node("file", F.concat(F.lit("p"), "p_partkey", F.lit(".py")), p_path, F.col("p_name"))))
        .unionByName(customer.select(*_node("file", F.concat(F.lit("c"), "c_custkey", F.lit(".go")), c_path, F.col("c_name"))))
        .unionByName(part.select(*_node("function", make, p_path, F.concat(F.lit("Function "), make), make)))
        .unionByName(orders.select(*_node("function", order, c_path, F.concat(F.lit("Order "), "o_orderstatus"), order)))
    )
    make_id, order_id = node_id("function", p_path, make), node_id("function", c_path, order)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    of_part = lambda key: lines.select("l_partkey", key).repartition("l_partkey").distinct().join(
        part.drop("p_name"), F.col("l_partkey") == F.col("p_partkey")).select(key, "p_partkey", "p_brand")
    bought = of_part("l_suppkey").join(supplier.drop("s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = bought.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    ordered = of_part("l_orderkey").join(orders.drop("o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = (
        bought.select(*edge(node_id("file", s_path), node_id("file", p_path), "imports"))
        .unionByName(part.select(*edge(node_id("file", p_path), make_id, "contains")))
        .unionByName(part.select(*edge(node_id("file", p_path), make_id, "exports")))
        .unionByName(orders.select(*edge(node_id("file", c_path), order_id, "contains")))
        .unionByName(ordered.select(*edge(order_id, make_id, "calls")))
    )
    return nodes, edges


#: The same tables for DuckDB, as common table expressions ``nodes`` and ``edges``.
TRADE_SQL = """
s AS (SELECT s_suppkey, s_name, 'supplier/' || n_name || '/s' || s_suppkey || '.ts' AS s_path, s_acctbal
      FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT p_partkey, p_name, 'part/' || p_brand || '/p' || p_partkey || '.py' AS p_path FROM part),
c AS (SELECT c_custkey, c_name, 'customer/' || c_mktsegment || '/c' || c_custkey || '.go' AS c_path FROM customer),
o AS (SELECT o_orderkey, o_orderstatus, c_path, 'function:' || c_path || ':order' || o_orderkey AS o_id
      FROM orders JOIN c ON o_custkey = c_custkey),
nodes AS (
  SELECT 'file:' || s_path AS node_id, 'file' AS kind, 's' || s_suppkey || '.ts' AS name, s_path AS path, s_name AS summary,
         'supplier' AS layer, 'structural' AS provenance FROM s
  UNION ALL SELECT 'file:' || p_path, 'file', 'p' || p_partkey || '.py', p_path, p_name, 'part', 'structural' FROM p
  UNION ALL SELECT 'file:' || c_path, 'file', 'c' || c_custkey || '.go', c_path, c_name, 'customer', 'structural' FROM c
  UNION ALL SELECT 'function:' || p_path || ':make' || p_partkey, 'function', 'make' || p_partkey, p_path,
         'Function make' || p_partkey, NULL, 'structural' FROM p
  UNION ALL SELECT o_id, 'function', 'order' || o_orderkey, c_path, 'Order ' || o_orderstatus, NULL, 'structural' FROM o),
edges AS (
  SELECT 'file:' || s_path AS source, 'file:' || p_path AS target, 'imports' AS kind, 0.7::DOUBLE AS weight
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN p ON l_partkey = p_partkey JOIN s ON l_suppkey = s_suppkey
  UNION ALL SELECT 'file:' || p_path, 'function:' || p_path || ':make' || p_partkey, 'contains', 1.0 FROM p
  UNION ALL SELECT 'file:' || p_path, 'function:' || p_path || ':make' || p_partkey, 'exports', 0.5 FROM p
  UNION ALL SELECT 'file:' || c_path, o_id, 'contains', 1.0 FROM o
  UNION ALL SELECT o_id, 'function:' || p_path || ':make' || p_partkey, 'calls', 0.9
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN p ON l_partkey = p_partkey JOIN o ON l_orderkey = o_orderkey)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls from the world to regions to nations to customers to orders, as (source, target)."""
    t = lambda name: table(spark, sf_dir, name)
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), key)
    region = t("region").select(F.lit("world:0").alias("source"), name("region", "r_regionkey").alias("target"))
    nation = t("nation").select(name("region", "n_regionkey").alias("source"), name("nation", "n_nationkey").alias("target"))
    customer = t("customer").select(name("nation", "c_nationkey").alias("source"), name("customer", "c_custkey").alias("target"))
    orders = t("orders").select(name("customer", "o_custkey").alias("source"), name("order", "o_orderkey").alias("target"))
    return region.unionByName(nation).unionByName(customer).unionByName(orders)


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls from customers to orders to parts to suppliers, as (source, target), as often as the tables have them."""
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), key)
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(name("customer", "o_custkey").alias("source"), name("order", "o_orderkey").alias("target"))
    parts = lines.select(name("order", "l_orderkey").alias("source"), name("part", "l_partkey").alias("target"))
    suppliers = lines.select(name("part", "l_partkey").alias("source"), name("supplier", "l_suppkey").alias("target"))
    return orders.unionByName(parts).unionByName(suppliers)


CHAIN_SQL = """
calls AS (
  SELECT 'world:0' AS source, 'region:' || r_regionkey AS target FROM region
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file node for each document; its summary is the text."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/d"), F.col("doc_id"), F.lit(".md"))
    return docs.select(*_node("file", F.concat(F.lit("d"), "doc_id", F.lit(".md")), path, F.col("text")))


DOCUMENTS_SQL = """
docs AS (SELECT 'file:' || lang || '/' || source || '/d' || doc_id || '.md' AS node_id, 'file' AS kind,
  'd' || doc_id || '.md' AS name, lang || '/' || source || '/d' || doc_id || '.md' AS path, text AS summary FROM documents)"""
