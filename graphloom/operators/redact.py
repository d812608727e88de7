"""Redaction of generated prose before a map is shared.

Tables of a map, as ``mapfile.read_map`` or the operators give them, are redacted by
``redacted`` on their own column names. Lists of a map file are redacted by
``redacted_rows`` on the contract's names, nested objects each by their own provenance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import model
from graphloom.sources.mapfile import MAP

MARKER = "[redacted]"
#: The fields that may leave; any other column is dropped. Prose fields are
#: replaced unless the row's provenance is exactly ``structural``.
FIELDS = {
    "nodes": {"keep": ("node_id", "kind", "path", "layer", "provenance", "name"), "prose": ("summary",)},
    "layers": {"keep": ("layer_id", "provenance"), "prose": ("name", "description")},
    "flows": {"keep": ("flow_id", "domain", "provenance"), "prose": ("name",)},
    "tour": {"keep": ("pos", "node_id", "provenance"), "prose": ("label",)},
}
#: The map contract's types by the list or field that holds them, and its prose.
LISTS = {"nodes": "Node", "edges": "Edge", "layers": "Layer", "domain_flows": "DomainFlow", "tour": "TourStep"}
NESTED = {"Node.range": "Range", "Layer.description": "LayerDescription", "KnowledgeGraph.project": "Project"}
PROSE = ("Node.summary", "Layer.name", "LayerDescription.text", "DomainFlow.name", "TourStep.label")
PROVENANCES = ("structural", "llm")


def _secret() -> Column:
    return ~F.col("provenance").eqNullSafe(F.lit("structural"))


def redacted(table: DataFrame, kind: str) -> DataFrame:
    """The known columns of ``table`` with generated prose replaced."""
    rule = FIELDS[kind]
    kept = [c for c in rule["keep"] if c in table.columns]
    prose = [F.when(_secret(), F.lit(MARKER)).otherwise(F.col(c)).alias(c) for c in rule["prose"] if c in table.columns]
    return table.select(*kept, *prose)


def _disclosed(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(field, n): the counts that are not 0, from one aggregation."""
    if not counts:
        return rows.sparkSession.createDataFrame([], "field string, n long")
    one = rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(counts.values())))
    pairs = F.array(*(F.struct(F.lit(field).alias("field"), F.col(f"c{i}").alias("n")) for i, field in enumerate(counts)))
    return one.select(F.inline(pairs)).where("n > 0")


def disclosure(table: DataFrame, kind: str) -> DataFrame:
    """(field, n): how many values of each field redaction replaces or drops."""
    rule = FIELDS[kind]
    known = {*rule["keep"], *rule["prose"]}
    counts = {f"{kind}.{c}": F.count_if(_secret() & F.col(c).isNotNull()) for c in rule["prose"] if c in table.columns}
    return _disclosed(table, counts | {f"{kind}.{c}": F.count(c) for c in table.columns if c not in known})


def _contract() -> dict[str, list[str]]:
    """The fields of each type of the map contract, from the schema that maps are read by."""
    out: dict[str, list[str]] = {}

    def learn(name: str, schema: T.StructType) -> None:
        out[name] = schema.fieldNames()
        for f in schema:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                learn(NESTED.get(f"{name}.{f.name}") or LISTS[f.name], inner)

    learn("KnowledgeGraph", T.StructType.fromDDL(MAP))
    return out


def _part(of: Column | None, field: str) -> Column:
    name = "`" + field.replace("`", "``") + "`"
    return F.col(name) if of is None else of.getField(field)


def _object(kind: str, schema: T.StructType, at: Column | None, known: dict[str, list[str]]) -> tuple[list[Column], dict[str, Column]]:
    """The fields of an object as they may leave, and what each loses."""
    mechanical = F.lit(False)
    if "provenance" in schema.fieldNames() and isinstance(schema["provenance"].dataType, T.StringType):
        mechanical = _part(at, "provenance").eqNullSafe(F.lit("structural"))
    kept, lost = [], {}
    for f in schema:
        value, field = _part(at, f.name), f"{kind}.{f.name}"
        if f.name not in known[kind]:
            lost[field] = F.count(value)
        elif field in PROSE:
            hidden = ~mechanical & value.isNotNull()
            kept.append(F.when(hidden, F.lit(MARKER)).otherwise(value).alias(f.name))
            lost[field] = F.count_if(hidden)
        elif field in NESTED and isinstance(f.dataType, T.StructType):
            inner, more = _object(NESTED[field], f.dataType, value, known)
            lost |= more
            if inner:
                kept.append(F.when(value.isNotNull(), F.struct(*inner)).alias(f.name))
        else:
            kept.append(value.alias(f.name))
    return kept, lost


def redacted_rows(rows: DataFrame, part: str) -> DataFrame:
    """Rows of the map's list ``part`` as they may be shared.

    A field the contract doesn't know is dropped, at any depth. Prose is replaced unless
    the object that holds it says of itself that it is ``structural``.
    """
    return rows.select(*_object(LISTS[part], rows.schema, None, _contract())[0])


def disclosed_rows(rows: DataFrame, part: str) -> DataFrame:
    """(field, n): how many values of ``Type.field`` redaction replaces or drops, nulls not counted."""
    return _disclosed(rows, _object(LISTS[part], rows.schema, None, _contract())[1])


def misshapen(rows: DataFrame, part: str) -> DataFrame:
    """(rule, subject): values that are none of the contract's, and rows without the fields that identify them."""
    ids = {"nodes": ("id", "path"), "edges": ("source", "target"), "layers": ("id",), "domain_flows": ("id",), "tour": ("node",)}[part]
    allowed = {"provenance": PROVENANCES}
    if part in ("nodes", "edges"):
        allowed["kind"] = model.KINDS if part == "nodes" else tuple(model.WEIGHTS)
    must = ids + (("kind",) if "kind" in allowed else ())
    lacking = [F.when(_part(None, c).isNull(), F.struct(F.lit(f"{part} without {c}").alias("rule"), _part(None, ids[0]).alias("subject"))) for c in must if c in rows.columns]
    lacking += [F.struct(F.lit(f"{part} without {c}").alias("rule"), F.lit(None).cast("string").alias("subject")) for c in must if c not in rows.columns]
    odd = [F.when(~_part(None, c).isin(*good), F.struct(F.lit(f"unknown {c} in {part}").alias("rule"), _part(None, c).alias("subject")))
           for c, good in allowed.items() if c in rows.columns]
    return rows.select(F.inline(F.array_compact(F.array(*lacking, *odd))))


def share(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The redacted lists of a map file, and (field, n) of what they lost.

    A file that is no map is refused: it is first read by the contract's schema, where a
    value of another type raises, and unknown kinds or provenances raise too.
    """
    typed = spark.read.schema(MAP).option("multiLine", True).option("mode", "FAILFAST").json(path)
    whole = spark.read.option("multiLine", True).json(path)
    out, losses = {}, []
    known = _contract()
    for part in LISTS:
        wrong = misshapen(typed.select(F.inline(part)), part).limit(3).collect()
        if wrong:
            raise ValueError(f"the map does not conform to its contract: {[tuple(r) for r in wrong]}")
        if part not in whole.columns or not isinstance(getattr(whole.schema[part].dataType, "elementType", None), T.StructType):
            continue
        rows = whole.select(F.inline(part))
        out[part] = redacted_rows(rows, part)
        losses.append(disclosed_rows(rows, part))
    unknown = {f"KnowledgeGraph.{c}": F.count(_part(None, c)) for c in whole.columns if c not in known["KnowledgeGraph"]}
    if "project" in whole.columns and isinstance(whole.schema["project"].dataType, T.StructType):
        fields, lost = _object("Project", whole.schema["project"].dataType, F.col("project"), known)
        out["project"] = whole.select(*fields)
        unknown |= lost
    lost_all = _disclosed(whole, unknown)
    for more in losses:
        lost_all = lost_all.unionByName(more)
    return out, lost_all.orderBy("field")
