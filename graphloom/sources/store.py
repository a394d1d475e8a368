"""A graph as a folder of Parquet tables with a small table that describes them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..graph import EdgeTable, Graph, VertexTable


def write_graph(graph: Graph, path: str, spark: SparkSession) -> None:
    """Edges are written sorted by source within tasks, so that scans by source skip row groups."""
    about = []
    for i, t in enumerate(graph.vertices):
        t.df.write.mode("overwrite").parquet(f"{path}/v{i}")
        about.append({"kind": "v", "no": i, "name": t.name, "labels": sorted(t.labels), "dynamic": t.dynamic})
    for i, e in enumerate(graph.edges):
        e.df.sortWithinPartitions("s").write.mode("overwrite").parquet(f"{path}/e{i}")
        about.append({"kind": "e", "no": i, "name": e.name, "label": e.label, "src": e.src, "dst": e.dst, "directed": e.directed})
    about.append({"kind": "g", "no": 0, "complete": graph.complete})
    spark.createDataFrame([(json.dumps(x),) for x in about], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_graph(spark: SparkSession, path: str) -> Graph:
    about = sorted((json.loads(r["value"]) for r in spark.read.text(f"{path}/about").collect()), key=lambda x: (x["kind"], x["no"]))
    vs = tuple(VertexTable(x["name"], frozenset(x["labels"]), spark.read.parquet(f"{path}/v{x['no']}"), x["dynamic"]) for x in about if x["kind"] == "v")
    es = tuple(EdgeTable(x["name"], x["label"], spark.read.parquet(f"{path}/e{x['no']}"), x["src"], x["dst"], x["directed"]) for x in about if x["kind"] == "e")
    return Graph(vs, es, next(x["complete"] for x in about if x["kind"] == "g"))
