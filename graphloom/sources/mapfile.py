"""Maps, overlays and annotation stores as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import model
from graphloom.session import exists

MAP = (
    "version string, project struct<name: string>, "
    "nodes array<struct<id: string, kind: string, name: string, path: string, summary: string, "
    "range: struct<start_line: int, end_line: int>, layer: string, significance: int, provenance: string>>, "
    "edges array<struct<source: string, target: string, kind: string, weight: double>>, "
    "layers array<struct<id: string, name: string, description: struct<text: string, provenance: string>, provenance: string>>, "
    "domain_flows array<struct<id: string, name: string, domain: string, steps: array<string>, provenance: string>>, "
    "tour array<struct<node: string, label: string, provenance: string>>"
)
STORE_VERSION = 2
#: Nodes and edges that a map file may hold.
MOST = 500_000
ENTRY = "map<string, struct<content_hash: string, summary: string>>"
TEXT = "map<string, struct<inputs_hash: string, text: string>>"
STORE = f"version int, annotations {ENTRY}, layers {TEXT}, layer_descriptions {TEXT}, flows {TEXT}, tour {TEXT}"


def read_map(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a map file; absent arrays are empty tables. A file that is
    no map raises. Lists keep their order in ``seq``."""
    whole = spark.read.schema(MAP).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = lambda c: whole.select(F.posexplode(c).alias("seq", "x")).select("seq", "x.*")
    out = {c: rows(c) for c in ("edges", "layers", "domain_flows", "tour")}
    out["nodes"] = rows("nodes").withColumnRenamed("id", "node_id")
    out["project"] = whole.select("version", "project.name")
    return out


def _create(spark: SparkSession, path: str, document: dict) -> None:
    import json

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray((json.dumps(document, indent=2, ensure_ascii=False) + "\n").encode()))
    stream.close()


def _plain(row) -> dict:
    """A row as JSON objects; absent values are left out."""
    return {k: _plain(v) if hasattr(v, "asDict") else v for k, v in row.asDict().items() if v is not None}


def write_map(
    nodes: DataFrame, edges: DataFrame, layers: DataFrame, path: str, project: str, version: str = "0.5.0",
    flows: DataFrame | None = None, tour: DataFrame | None = None,
) -> None:
    """One JSON document, whose lists are sorted by id; the tour keeps its order.

    ``nodes`` may carry ``range`` and ``significance``; ``flows`` are (flow_id, name,
    domain, steps, provenance) and ``tour`` (pos, node_id, label). The contract file is a
    single document, so it is put together in one place: a map of over ``MOST`` rows is
    refused and stays tables (``published``).
    """
    spark = nodes.sparkSession
    if nodes.count() + edges.count() > MOST:
        raise ValueError(f"a map file holds at most {MOST} nodes and edges; publish the map as tables")
    told = F.struct(F.col("description").alias("text"), "provenance")
    lists = {
        "nodes": nodes.withColumnRenamed("node_id", "id").orderBy("path", "id"),
        "edges": edges.orderBy("source", "target", "kind"),
        "layers": layers.select(F.col("layer_id").alias("id"), "name", told.alias("description"), "provenance").orderBy("id"),
    }
    if flows is not None:
        lists["domain_flows"] = flows.select(F.col("flow_id").alias("id"), "name", "domain", "steps", "provenance").orderBy("id")
    if tour is not None:
        lists["tour"] = tour.orderBy("pos").select(F.col("node_id").alias("node"), "label", F.lit("structural").alias("provenance"))
    _create(spark, path, {"version": version, "project": {"name": project}} | {k: [_plain(r) for r in df.toLocalIterator()] for k, df in lists.items()})


SECTIONS = ("annotations", "layers", "layer_descriptions", "flows", "tour")


def unknown_sections(spark: SparkSession, path: str) -> dict:
    """Top-level sections of an existing store of our version that this module does not know.

    A store is one JSON document of at most ``MOST`` texts, so it is read as one.
    """
    import json

    if not exists(spark, path):
        return {}
    lines = spark.read.text(path, wholetext=True).head()
    try:
        document = json.loads(lines[0]) if lines else {}
    except ValueError:
        return {}
    if not isinstance(document, dict) or document.get("version") != STORE_VERSION:
        return {}
    return {k: v for k, v in document.items() if k not in ("version", "produced_by", *SECTIONS)}


def write_store(annotations: DataFrame, path: str, provider: str | None = None, date: str | None = None) -> None:
    """The annotation store of (section, key, hash, text), keys sorted; the inverse of ``read_store``.

    What the store at ``path`` has beside the known sections, as a newer writer left it, is kept.
    """
    spark = annotations.sparkSession
    kept = unknown_sections(spark, path)
    if annotations.count() > MOST:
        raise ValueError(f"a store holds at most {MOST} texts")
    document: dict = {"version": STORE_VERSION} | ({"produced_by": {"provider": provider, "date": date}} if provider else {})
    document |= {section: {} for section in SECTIONS}
    for r in annotations.where(F.col("section").isin(*SECTIONS)).orderBy("section", "key").toLocalIterator():
        names = ("content_hash", "summary") if r.section == "annotations" else ("inputs_hash", "text")
        document[r.section][r.key] = {names[0]: r["hash"], names[1]: r["text"]}
    _create(spark, path, document | kept)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, hash, text) of an annotation store.

    A missing or unreadable file and one of another version are an empty store.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    empty = spark.createDataFrame([], "section string, key string, hash string, text string")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return empty
    whole = spark.read.schema(STORE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where(F.col("version") == STORE_VERSION)
    out = empty
    for section in SECTIONS:
        names = ("content_hash", "summary") if section == "annotations" else ("inputs_hash", "text")
        rows = whole.select(F.lit(section).alias("section"), F.explode(section).alias("key", "v"))
        out = out.unionByName(rows.select("section", "key", F.col(f"v.{names[0]}").alias("hash"), F.col(f"v.{names[1]}").alias("text")))
    return out


def overlay_json(marks: DataFrame, unmapped: DataFrame) -> DataFrame:
    """One row of JSON: the sorted changed and affected nodes and unmapped paths."""
    status = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("node_id"))))
    ids = marks.agg(status("changed").alias("changed"), status("affected").alias("affected"), F.lit(1).alias("version"))
    paths = unmapped.agg(F.array_sort(F.collect_set("path")).alias("unmapped_paths"), F.lit(1).alias("version"))
    return ids.join(paths, "version").select(F.to_json(F.struct("version", "changed", "affected", "unmapped_paths")).alias("json"))


def json_schema(schema: T.DataType, patterns: dict[str, str] | None = None) -> dict:
    """The JSON Schema of a Spark type; ``patterns`` gives those of string fields by name."""
    patterns = patterns or {}
    if isinstance(schema, T.StructType):
        fields = {f.name: json_schema(f.dataType, patterns) | ({"pattern": patterns[f.name]} if f.name in patterns else {}) for f in schema}
        return {"type": "object", "properties": fields, "required": [f.name for f in schema if not f.nullable]}
    if isinstance(schema, T.ArrayType):
        return {"type": "array", "items": json_schema(schema.elementType, patterns)}
    if isinstance(schema, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(schema.valueType, patterns)}
    simple = {"string": "string", "int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean"}
    return {"type": simple[schema.simpleString()]}


def write_ignore_file(folder: str, kept: str = "annotations.json") -> bool:
    """Write ``.gitignore`` that keeps only the store; an existing one is never touched."""
    try:
        with open(f"{folder}/.gitignore", "x") as f:
            f.write(f"*\n!.gitignore\n!{kept}\n")
        return True
    except FileExistsError:
        return False


def edges_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Edges of a read map in the model's columns, dangling ones left out."""
    ids = tables["nodes"].select("node_id")
    edges = tables["edges"].select("source", "target", "kind", F.coalesce("weight", model.weight(F.col("kind"))).alias("weight"))
    kept = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "target", "kind", "weight")
