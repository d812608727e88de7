"""The public face of a map: lazy tables, and questions as methods."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph, overlay, regions, retrieval, semantics, trigrams
from graphloom.sources import mapfile, published, repository


class CodeMap:
    """Nodes and edges, and what can be asked of them. Every answer is a DataFrame."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def scan(cls, spark: SparkSession, root: str) -> CodeMap:
        return cls(*repository.scan(spark, root))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> CodeMap:
        """The map that is published now; it stays that one, whatever is published later."""
        return cls(*published.load(spark, path, version))

    def publish(self, path: str) -> CodeMap:
        """Write the map and make it the one that readers find; the one returned reads what was written."""
        version = published.publish(self.nodes, self.edges, path)
        return CodeMap.load(self.nodes.sparkSession, path, version)

    @cached_property
    def significance(self) -> DataFrame:
        return semantics.significance(self.nodes, self.edges)

    @cached_property
    def layers(self) -> DataFrame:
        return semantics.layers(self.nodes)

    @cached_property
    def flow_steps(self) -> DataFrame:
        return semantics.flow_steps(self.nodes, self.edges)

    @cached_property
    def flows(self) -> DataFrame:
        return semantics.flows(self.nodes, self.flow_steps)

    def tour(self) -> DataFrame:
        return semantics.tour(semantics.contenders(self.nodes, self.edges))

    def blast_radius(self, changed: DataFrame) -> DataFrame:
        return overlay.overlay(self.nodes, self.edges, changed)

    def regions(self, grouping: str = "structural") -> DataFrame:
        """Regions by directory, or by ``domain``."""
        steps = self.flow_steps if grouping == "domain" else self.nodes
        return regions.regions_of(self.nodes, self.edges, self.layers, steps, grouping)

    def region_links(self) -> DataFrame:
        return regions.region_links(self.nodes, self.edges, regions.file_regions(self.nodes))

    def neighbourhood(self, focus: DataFrame) -> DataFrame:
        return graph.neighbourhood(self.nodes, self.edges, focus)

    def search(self, needle: str) -> DataFrame:
        return retrieval.search(self.nodes, needle)

    def context(self, question: str, cited: DataFrame | None = None) -> DataFrame:
        return retrieval.context_slice(self.nodes, question, cited)

    def index(self, path: str | None = None) -> trigrams.Index:
        """An index for searches, and for the slices and answers of many questions."""
        return trigrams.build(self.nodes, path)

    def export(self, folder: str, project: str) -> str:
        """Write the map as one JSON document below ``folder``, named after the project; its path."""
        spark = self.nodes.sparkSession
        name = spark.range(1).select(text.slug(F.lit(project)).alias("name")).head()["name"]
        mapfile.write_map(self.nodes, self.edges, self.layers, f"{folder}/{name}-map.json", project)
        return f"{folder}/{name}-map.json"

    def register_views(self) -> None:
        """``nodes``, ``edges``, ``layers``, ``significance`` and ``flows`` for SQL."""
        for name in ("nodes", "edges", "layers", "significance", "flows"):
            getattr(self, name).createOrReplaceTempView(name)
