"""Catalog and session statements."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import functions as F

from ..gql import ast as A
from ..functions.scalars import spark_type
from ..graph import Graph, VectorIndex, VertexTable
from .scope import GraphQueryError


def _exists(engine: Any, kind: str, name: str) -> bool:
    c = engine.catalog
    return name in {"schema": c.schemas, "graph": c.graphs, "graph_type": c.types, "index": c.indexes, "constraint": c.indexes, "vector_index": c.vectors}[kind]


def empty_graph(spark: Any, elements: list[dict]) -> Graph:
    """A graph without elements whose tables are those of a graph type."""
    g = Graph(schema=tuple((repr(x),) for x in elements))
    for x in elements:
        if "node" in x:
            n = x["node"]
            labels = frozenset(_names(n["label"])) or frozenset([n["name"]])
            if any(t.labels == labels for t in g.vertices):
                continue
            cols = ", ".join(["k string", *(f"`p@{p}` {spark_type(t)}" for p, t in n["props"].items())])
            df = spark.createDataFrame([], cols)
            g = replace(g, vertices=(*g.vertices, VertexTable("&".join(sorted(labels)), labels, df)))
    return g


def _names(label: Any) -> set[str]:
    if label is None:
        return set()
    if label.kind == "name":
        return {label.data}
    return {n for x in label.args for n in _names(x)}


def check_unique(graph: Graph, label: str, edge: bool, props: tuple[str, ...]) -> None:
    """An error if two elements share all of the properties' values; nulls never clash."""
    for t in graph.edges if edge else graph.vertices:
        if (t.label != label if edge else label not in t.labels) or not set(props) <= set(t.props):
            continue
        cols = [F.col(f"`p@{p}`") for p in props]
        some = t.df
        for c in cols:
            some = some.where(c.isNotNull())
        if some.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
            raise GraphQueryError(f"{label}({', '.join(props)}) is not unique")


def run(engine: Any, s: A.Catalog, compiler: Any) -> None:
    c, d = engine.catalog, s.data
    verb, _, kind = s.action.partition("_")
    if verb in ("create", "drop"):
        there = _exists(engine, kind, s.name)
        if verb == "create" and there and not d.get("replace"):
            if d.get("if_not_exists"):
                return
            raise GraphQueryError(f"{s.name} exists already")
        if verb == "drop" and not there:
            if d.get("if_exists"):
                return
            raise GraphQueryError(f"{s.name} doesn't exist")
    if s.action == "create_schema":
        c.schemas.add(s.name)
    elif s.action == "drop_schema":
        c.schemas.discard(s.name)
    elif s.action == "create_graph":
        if "like" in d:
            c.graphs[s.name] = c.graph(d["like"])
        elif "type" in d:
            if d["type"] not in c.types:
                raise GraphQueryError(f"no graph type is named {d['type']}")
            c.graphs[s.name] = empty_graph(engine.spark, c.types[d["type"]])
        elif "elements" in d:
            c.graphs[s.name] = empty_graph(engine.spark, d["elements"])
        else:
            c.graphs[s.name] = Graph()
    elif s.action == "drop_graph":
        del c.graphs[s.name]
    elif s.action == "create_graph_type":
        c.types[s.name] = list(c.types[d["like"]]) if "like" in d else d.get("elements", [])
    elif s.action == "drop_graph_type":
        del c.types[s.name]
    elif s.action == "create_index":
        c.indexes[s.name] = d | {"unique": False}
    elif s.action == "create_constraint":
        check_unique(engine.graph, d["label"], d["edge"], tuple(d["props"]))
        c.indexes[s.name] = d | {"unique": True}
        g = engine.graph
        c.graphs[engine.current] = replace(g, unique=(*g.unique, (d["label"], d["edge"], tuple(d["props"]))))
    elif s.action in ("drop_index", "drop_constraint"):
        gone = c.indexes.pop(s.name)
        g = engine.graph
        c.graphs[engine.current] = replace(g, unique=tuple(u for u in g.unique if u != (gone["label"], gone["edge"], tuple(gone["props"])) or not gone["unique"]))
    elif s.action == "create_vector_index":
        o = d.get("options", {})
        metric = str(o.get("metric", "l2")).lower()
        metric = "cosine" if metric == "cosine" else "l2" if metric.startswith("l2") or metric == "euclidean" else None
        if metric is None:
            raise GraphQueryError("a vector index has metric l2 or cosine")
        if str(o.get("encoding", "f32")).lower() not in ("f32", "i8"):
            raise GraphQueryError("a vector index has encoding f32 or i8")
        c.vectors[s.name] = VectorIndex(s.name, d["label"], d["props"][0], metric, o.get("dims") or o.get("dimensions"), str(o.get("encoding", "f32")).lower())
    elif s.action == "drop_vector_index":
        del c.vectors[s.name]
    elif s.action == "session_graph":
        c.graph(s.name)
        engine.current = s.name
    elif s.action == "session_schema":
        engine.session["schema"] = s.name
    elif s.action == "session_zone":
        engine.spark.conf.set("spark.sql.session.timeZone", str(compiler.expressions.constant_of(d["value"])))
    elif s.action == "session_param":
        engine.session["params"][s.name] = compiler.expressions.constant_of(d["value"])
    elif s.action == "session_reset":
        if d["what"] in (None, "PARAMETERS"):
            engine.session["params"].clear()
        if d["what"] == "PARAMETER" and s.name:
            engine.session["params"].pop(s.name, None)
        if d["what"] in (None, "GRAPH"):
            engine.current = next(iter(c.graphs))
    elif s.action == "session_close":
        engine.session["params"].clear()
    elif s.action == "start_transaction":
        engine.begin()
    elif s.action == "commit":
        engine.commit()
    elif s.action == "rollback":
        engine.rollback()
    else:
        raise GraphQueryError(f"{s.action} is not known")
