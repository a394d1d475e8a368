"""Graphs from JSON: one document with vertices and edges, or newline-delimited rows.

A vertex row has source_id, labels and properties; an edge row has source, target, label, directed (true by
default), inline_value and properties.  An end is a source_id or {label, property, value}.  Values may be
plain, or objects of one key that names their type, such as {"Int64": 42}.
"""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from ..graph import Graph

# The type names of typed values and what they are here.
TYPES = {"Null": "string", "Bool": "boolean", "Int8": "byte", "Int16": "short", "Int32": "int", "Int64": "long", "Int128": "decimal(38,0)", "Uint8": "short", "Uint16": "int", "Uint32": "long", "Uint64": "decimal(20,0)", "Uint128": "decimal(38,0)", "Float16": "float", "Float32": "float", "Float64": "double", "Decimal": "decimal(28,10)", "Text": "string", "Bytes": "binary", "Date": "date", "DateTime": "timestamp", "List": "", "Record": "", "Path": ""}

MOST_SETS = 500  # of labels, above which vertices keep theirs in a column


def decoded(c: Column, kind: Any) -> Column:
    """A typed value, or whatever stands there plainly."""
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: decoded(x, kind.elementType))
    if not isinstance(kind, StructType):
        return c
    if kind.names and set(kind.names) <= TYPES.keys():
        found = []
        for f in kind.fields:
            x = c.getField(f.name)
            if f.name == "Null":
                continue
            if f.name in ("List", "Record", "Path"):
                found.append(decoded(x, f.dataType))
            elif f.name == "Bytes":
                found.append(F.unbase64(x))
            elif f.name == "Date":
                found.append(F.date_add(F.lit("1970-01-01").cast("date"), x.cast("int")))
            elif f.name == "DateTime":
                found.append(F.timestamp_micros(x.getField("seconds") * 1_000_000 + F.floor(x.getField("nanos") / 1000)))
            else:
                found.append(x.cast(TYPES[f.name]))
        return F.coalesce(*found) if found else F.lit(None)
    return F.struct(*(decoded(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields))


def _properties(df: DataFrame, prefix: str = "") -> DataFrame:
    kind = df.schema["properties"].dataType if "properties" in df.columns else StructType()
    out = {f"{prefix}{f.name}": decoded(F.col("properties").getField(f.name), f.dataType) for f in getattr(kind, "fields", [])}
    return df.withColumns({f"p:{n}": c for n, c in out.items()})


def load_rows(vertices: DataFrame, edges: DataFrame | None) -> Graph:
    """A graph from frames of vertex and edge rows."""
    v = _properties(vertices).withColumn("labels", F.array_sort(F.array_distinct(F.coalesce(F.col("labels"), F.array().cast("array<string>")))))
    ids = v.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR source_id IS NULL").limit(1).collect()
    if ids:
        raise ValueError(f"source_id {ids[0]['source_id']!r} occurs {ids[0]['n']} times")
    props = [c for c in v.columns if c.startswith("p:")]
    named = v.select("source_id", "labels", *(F.col(f"`{c}`").alias(c[2:]) for c in props))
    sets = [r["labels"] for r in v.select("labels").distinct().limit(MOST_SETS + 1).collect()]
    g = Graph()
    names = [c[2:] for c in props]
    if len(sets) > MOST_SETS:
        g = g.with_vertices((), named, "source_id", names, "vertices", "labels")
        table = F.lit("vertices")
    else:
        for s in sorted(sets):
            mine = named.where(F.col("labels") == F.array(*map(F.lit, s)).cast("array<string>"))
            g = g.with_vertices(tuple(s), mine, "source_id", names, name="&".join(s) or "vertices")
        table = F.when(F.size("labels") == 0, "vertices").otherwise(F.array_join("labels", "&"))
    if edges is None:
        return g
    where = v.select(F.col("source_id").alias("id"), table.alias("at"), "labels", *(F.col(f"`{c}`") for c in props))
    e = _properties(edges)
    if "directed" not in e.columns:
        e = e.withColumn("directed", F.lit(True))
    if "label" not in e.columns:
        e = e.withColumn("label", F.lit(None).cast("string"))
    if "inline_value" in e.columns:
        e = e.withColumn("p:inline_value", decoded(F.col("inline_value"), e.schema["inline_value"].dataType))
    for end in ("source", "target"):
        e = _end(e, where, end)
    lost = e.where("source_at IS NULL OR target_at IS NULL").limit(1).collect()
    if lost:
        raise ValueError(f"an edge's end is no vertex: {lost[0].asDict(True)}")
    props = [c for c in e.columns if c.startswith("p:")]
    e = e.select("source_id", "source_at", "target_id", "target_at", "label", F.coalesce(F.col("directed").cast(BooleanType()), F.lit(True)).alias("directed"), *(F.col(f"`{c}`").alias(c[2:]) for c in props))
    kinds = sorted(((r["label"], r["directed"]) for r in e.select("label", "directed").distinct().collect()), key=str)
    for label, directed in kinds:
        mine = e.where(F.col("label").eqNullSafe(label) & (F.col("directed") == directed))
        g = g.with_edges(label, mine, (None, "source_id"), (None, "target_id"), [c[2:] for c in props], directed=directed, src_table="source_at", dst_table="target_at")
    return replace(g, complete=True)


def _end(e: DataFrame, vertices: DataFrame, end: str) -> DataFrame:
    """The end's id and table: by id, or by a label and a property's value."""
    kind = e.schema[end].dataType
    v = vertices.select(F.col("id").alias(f"{end}_id"), F.col("at").alias(f"{end}_at"))
    if isinstance(kind, StructType):
        value = decoded(F.col(end).getField("value"), kind["value"].dataType).cast("string")
        wide = vertices.select(F.col("id").alias(f"{end}_id"), F.col("at").alias(f"{end}_at"), "labels", F.explode(F.map_from_arrays(F.array(*(F.lit(c[2:]) for c in vertices.columns if c.startswith("p:"))), F.array(*(F.col(f"`{c}`").cast("string") for c in vertices.columns if c.startswith("p:"))))).alias("_p", "_v"))
        cond = (F.col(end).getField("property") == F.col("_p")) & (value == F.col("_v")) & F.array_contains("labels", F.col(end).getField("label"))
        return e.join(wide, cond, "left").drop("_p", "_v", "labels")
    if isinstance(kind, StringType) is False:
        e = e.withColumn(end, F.col(end).cast("string"))
    plain = e.where(~F.col(end).startswith("{") | F.col(end).isNull())
    looked = e.where(F.col(end).startswith("{"))
    out = plain.join(v, F.col(end) == F.col(f"{end}_id"), "left")
    if looked.limit(1).count():  # ids and lookups in one file: inferred as text
        spec = F.from_json(end, "label string, property string, value string")
        value = F.coalesce(*(F.get_json_object(spec["value"], f"$.{t}") for t in TYPES if t not in ("List", "Record", "Path", "Null")), spec["value"])
        parsed = looked.withColumn("_spec", F.struct(spec["label"].alias("label"), spec["property"].alias("property"), value.alias("value"))).drop(end).withColumnRenamed("_spec", end)
        found = _end(parsed, vertices, end)
        out = out.drop(end).unionByName(found.drop(end))
    return out


def load_document(spark: SparkSession, path: str) -> Graph:
    """One JSON document {format_version: 1, vertices, edges}, or YAML where its library is installed."""
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as err:
            raise ValueError("YAML files need the yaml library") from err
        text = "\n".join(r["value"] for r in spark.read.text(path).collect())
        lines = [json.dumps(yaml.safe_load(text))]
        doc = spark.read.json(spark.sparkContext.parallelize(lines))
    else:
        doc = spark.read.option("multiLine", True).json(path)
    version = doc.select("format_version").first()
    if version is None or version[0] != 1:
        raise ValueError("the document's format_version isn't 1")
    part = lambda n: doc.select(F.explode(n).alias("x")).select("x.*") if n in doc.columns and doc.schema[n].dataType != ArrayType(StringType()) else None
    v = part("vertices")
    if v is None:
        return Graph()
    return load_rows(v, part("edges"))


def load_lines(spark: SparkSession, vertices: str, edges: str | None = None) -> Graph:
    """Newline-delimited vertex and edge rows, read in parallel."""
    return load_rows(spark.read.json(vertices), spark.read.json(edges) if edges else None)


__all__ = ["decoded", "load_document", "load_lines", "load_rows"]
