"""Changing statements: the read part's rows are settled, then each makes a new graph."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..gql import ast as A
from ..gql.ast import Expr
from ..graph import EdgeTable, Graph, VertexTable, col
from ..operators.settle import settle
from .compiler import Compiler
from .ddl import check_unique
from .scope import Binding, GraphQueryError, Rows, uses

_CHANGES = (A.Insert, A.SetItems, A.Remove, A.Delete)


def is_change(b: A.Block) -> bool:
    return any(isinstance(c, _CHANGES) for s in b.statements if isinstance(s, A.Composite) for c in s.first.clauses)


def run(c: Compiler, b: A.Block) -> tuple[Graph, DataFrame | None]:
    """The graph afterwards, and the result if the statement returns one."""
    out = None
    for s in b.statements:
        if s.rest:
            raise GraphQueryError("a changing statement can't be part of a set operation")
        c.used = uses(s) | {}
        for x in A.walk(s):
            if isinstance(x, A.Delete):
                for e in x.vars:
                    c.used.pop(e.data, None)
        rows, changed = Rows(None), False
        for clause in s.first.clauses:
            if isinstance(clause, _CHANGES):
                if not changed and rows.df is not None:
                    rows = rows.at(settle(rows.df))
                changed = True
                rows = _apply(c, clause, rows)
            elif isinstance(clause, A.Return):
                rows = _refreshed(c, rows, clause) if changed else rows
                out = c.output(c.returned(clause, rows, []))
            else:
                rows = c.clause(clause, rows, [])
    for label, edge, props in c.graph.unique:
        check_unique(c.graph, label, edge, props)
    return c.graph, out


def _refreshed(c: Compiler, rows: Rows, r: A.Return) -> Rows:
    """The variables' properties as they are after the changes."""
    for name, b in list(rows.env.items()):
        if b.kind == "vertex" and rows.df is not None:
            drop = [x for x in b.columns(rows.df) if x not in b.identity()]
            rows = rows.at(rows.df.drop(*drop)).bound(name, replace(b, loaded=False, graph=c.graph))
            if c.needs(name):
                rows = c.loaded(rows, name)
    return rows


def _apply(c: Compiler, x: Any, rows: Rows) -> Rows:
    if isinstance(x, A.Insert):
        return _insert(c, x, rows)
    if isinstance(x, A.Delete):
        return _delete(c, x, rows)
    return _set(c, x, rows)


def _names(label: Expr | None) -> list[str]:
    if label is None:
        return []
    if label.kind == "name":
        return [label.data]
    if label.kind == "and":
        return [n for y in label.args for n in _names(y)]
    raise GraphQueryError("a new element has plain labels")


def _key_type(g: Graph) -> str:
    return g.vertices[0].df.schema["k"].dataType.simpleString() if g.vertices else "string"


def _insert(c: Compiler, x: A.Insert, rows: Rows) -> Rows:
    df = rows.df if rows.df is not None else c.unit().withColumn(c.fresh("unit"), F.lit(1))
    kind = _key_type(c.graph)
    number = c.fresh("row")
    new_nodes: list[tuple[str, A.Node]] = []
    env = dict(rows.env)
    for p in x.paths:
        p.parts = c.normalized(p.parts)
        for n in p.parts:
            if isinstance(n, A.Node) and n.var not in env and n.var not in [v for v, _ in new_nodes]:
                new_nodes.append((n.var, n))
    # a key for each new element, fixed by settling: unique, though not in a row
    top = 0
    if kind in ("bigint", "int"):
        tops = [t.df.agg(F.max("k")).first()[0] for t in c.graph.vertices]
        top = max([0, *(v for v in tops if v is not None)])
    df = df.withColumn(number, F.monotonically_increasing_id())
    keys = {}
    for i, (v, _) in enumerate(new_nodes):
        at = c.fresh(v)
        k = F.lit(top + 1 + i) + col(number) * len(new_nodes) if kind in ("bigint", "int") else F.concat(F.lit("new-"), F.expr("uuid()"))
        keys[f"{at}@k"] = k.cast(kind)
        env[v] = Binding("vertex", at, (), False, graph=c.graph)
    df = settle(df.withColumns(keys)) if keys else settle(df)
    g = c.graph
    for v, n in new_nodes:
        labels = frozenset(_names(n.label))
        found = next((t for t in g.vertices if not t.dynamic and t.labels == labels), None)
        here = Rows(df, rows.env)
        add = df.select(col(f"{env[v].at}@k").alias("k"), *(c.expressions(e, here).alias(f"p@{p}") for p, e in n.props))
        if found:
            t = replace(found, df=_appended(found.df, add))
            g = replace(g, vertices=tuple(t if u.name == t.name else u for u in g.vertices))
        else:
            t = VertexTable("&".join(sorted(labels)) or "vertices", labels, add)
            if any(u.name == t.name for u in g.vertices):
                t = replace(t, name=f"{t.name}_{len(g.vertices)}")
            g = replace(g, vertices=(*g.vertices, t))
        env[v] = replace(env[v], tables=(t.name,), graph=g)
        df = df.withColumn(f"{env[v].at}@t", F.lit(g.table_no(t.name)).cast("int"))
    for p in x.paths:
        for i in range(1, len(p.parts), 2):
            e = p.parts[i]
            if e.direction not in ("right", "left", "undirected"):
                raise GraphQueryError("a new edge is directed one way or undirected")
            a, b = env[p.parts[i - 1].var], env[p.parts[i + 1].var]
            if e.direction == "left":
                a, b = b, a
            label = (_names(e.label) or [None])[0]
            ends = [col(f"{a.at}@k").alias("s"), col(f"{b.at}@k").alias("d"), col(f"{a.at}@t").cast("int").alias("st"), col(f"{b.at}@t").cast("int").alias("dt")]
            add = df.select(*ends, *(c.expressions(v, Rows(df, rows.env)).alias(f"p@{q}") for q, v in e.props))
            found = next((t for t in g.edges if t.label == label and t.src is None and t.dst is None and t.directed == (e.direction != "undirected")), None)
            start = 0
            if found:
                start = (found.df.agg(F.max("e")).first()[0] or 0) + 1
            add = settle(add.withColumn("e", F.lit(start) + F.monotonically_increasing_id()))
            if found:
                g = replace(g, edges=tuple(replace(u, df=_appended(u.df, add)) if u is found else u for u in g.edges))
            else:
                name = label or "edges"
                if any(u.name == name for u in g.edges):
                    name = f"{name}_{len(g.edges)}"
                g = replace(g, edges=(*g.edges, EdgeTable(name, label, add, None, None, e.direction != "undirected")))
    c.graph = g
    return Rows(df, {n: replace(b, graph=g) for n, b in env.items() if not n.startswith(" ")})


def _appended(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def _delete(c: Compiler, x: A.Delete, rows: Rows) -> Rows:
    g = c.graph
    for e in x.vars:
        b = c.expressions.binding(e.data, rows) if e.kind == "var" else None
        if b is None or b.kind not in ("vertex", "edge"):
            raise GraphQueryError("only vertices and edges can be deleted")
        t, k = b.identity()
        gone = settle(rows.df.select(col(t).cast("int").alias("_t"), col(k).alias("_k")).where("_k IS NOT NULL").distinct())
        if b.kind == "edge":
            g = replace(g, edges=tuple(replace(u, df=u.df.join(gone.where(F.col("_t") == i), F.col("e") == F.col("_k"), "left_anti")) if u.name in b.tables else u for i, u in enumerate(g.edges)))
            continue
        edges = []
        for u in g.edges:
            left = u.df
            for static, no, key in ((u.src, "st", "s"), (u.dst, "dt", "d")):
                if static is not None:
                    if static not in b.tables:
                        continue
                    cond = (F.col("_t") == g.table_no(static)) & (F.col("_k") == F.col(key))
                else:
                    cond = (F.col("_t") == F.col(no)) & (F.col("_k") == F.col(key))
                if not x.detach and left.join(gone, cond, "left_semi").limit(1).count():
                    raise GraphQueryError("a vertex with edges can only be deleted by DETACH DELETE")
                if x.detach:
                    left = left.join(gone, cond, "left_anti")
            edges.append(replace(u, df=left))
        vertices = tuple(replace(u, df=u.df.join(gone.where(F.col("_t") == i), F.col("k") == F.col("_k"), "left_anti")) if u.name in b.tables else u for i, u in enumerate(g.vertices))
        g = replace(g, vertices=vertices, edges=tuple(edges))
    c.graph = g
    return rows


def _set(c: Compiler, x: A.SetItems | A.Remove, rows: Rows) -> Rows:
    for item in x.items:
        kind, v = item[0], item[1]
        b = c.expressions.binding(v, rows)
        if b.kind not in ("vertex", "edge"):
            raise GraphQueryError(f"{v} is neither a vertex nor an edge")
        t, k = b.identity()
        values: dict[str, Any] = {}
        drop_rest, label = False, None
        if isinstance(x, A.Remove):
            if kind == "prop":
                values[item[2]] = F.lit(None)
            else:
                label = (item[2], False)
        elif kind == "prop":
            values[item[2]] = c.expressions(item[3], rows)
        elif kind == "all":
            if item[2].kind != "record":
                raise GraphQueryError("all properties are set from a record")
            values = {n: c.expressions(e, rows) for n, e in zip(item[2].data, item[2].args, strict=True)}
            drop_rest = True
        else:
            label = (item[2], True)
        news = settle(rows.df.select(col(t).cast("int").alias("_t"), col(k).alias("_k"), *(e.alias(f"_new{i}") for i, e in enumerate(values.values()))).where("_k IS NOT NULL").groupBy("_t", "_k").agg(F.count(F.lit(1)).alias("_hit"), *(F.first(F.col(f"_new{i}")).alias(f"_new{i}") for i in range(len(values)))))
        g = c.graph
        if label is not None:
            if b.kind == "edge":
                raise GraphQueryError("an edge's label can't be changed")
            c.graph = _relabelled(g, b, news, *label)
            continue
        key = "k" if b.kind == "vertex" else "e"
        tables = []
        for i, u in enumerate(g.vertices if b.kind == "vertex" else g.edges):
            if u.name in b.tables:
                df = u.df.join(news.where(F.col("_t") == i), F.col(key) == F.col("_k"), "left")
                hit = F.col("_hit").isNotNull()
                cols = {}
                for j, p in enumerate(values):
                    old = col(f"p@{p}") if f"p@{p}" in df.columns else F.lit(None)
                    cols[f"p@{p}"] = F.when(hit, F.col(f"_new{j}")).otherwise(old)
                if drop_rest:
                    for f in u.df.schema:
                        if f.name.startswith("p@") and f.name[2:] not in values:
                            cols[f.name] = F.when(~hit, col(f.name))
                names = list(dict.fromkeys([*u.df.columns, *cols]))
                u = replace(u, df=df.withColumns(cols).select(*map(col, names)))
            tables.append(u)
        c.graph = replace(g, **{"vertices" if b.kind == "vertex" else "edges": tuple(tables)})
    return rows


def _relabelled(g: Graph, b: Binding, news: DataFrame, label: str, add: bool) -> Graph:
    """Tables whose labels now differ by row get a column of labels."""
    tables = []
    for i, u in enumerate(g.vertices):
        if u.name in b.tables:
            now = F.col("ls") if u.dynamic else F.array(*map(F.lit, sorted(u.labels))).cast("array<string>")
            changed = F.array_sort(F.array_union(now, F.array(F.lit(label)))) if add else F.array_remove(now, label)
            df = u.df.join(news.where(F.col("_t") == i), F.col("k") == F.col("_k"), "left").withColumn("ls", F.when(F.col("_hit").isNotNull(), changed).otherwise(now))
            names = list(dict.fromkeys([*u.df.columns, "ls"]))
            u = replace(u, df=df.select(*map(col, names)), dynamic=True)
        tables.append(u)
    return replace(g, vertices=tuple(tables))
