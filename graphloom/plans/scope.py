"""What the variables of a query stand for, and where their values lie in the DataFrame of bindings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..gql import ast as A
from ..gql.ast import Expr
from ..graph import Graph, col, quoted


class GraphQueryError(ValueError):
    """The query can't be run as written."""


@dataclass(frozen=True)
class Binding:
    """kind: vertex edge value vertices edges path paths; tables: candidates among the graph's tables."""

    kind: str
    at: str  # the columns' prefix; of a value its column
    tables: tuple[str, ...] = ()
    loaded: bool = True  # whether property columns are there
    props: frozenset[str] = frozenset()
    graph: Any = None

    def columns(self, df: DataFrame) -> list[str]:
        if self.kind == "value":
            return [self.at]
        return [c for c in df.columns if c.startswith(self.at + "@")]

    def identity(self) -> list[str]:
        return {"vertex": [f"{self.at}@t", f"{self.at}@k"], "edge": [f"{self.at}@t", f"{self.at}@id"], "value": [self.at], "vertices": [f"{self.at}@list"], "edges": [f"{self.at}@list"], "path": [f"{self.at}@v", f"{self.at}@e"], "paths": [f"{self.at}@list"]}[self.kind]


@dataclass(frozen=True)
class Rows:
    """The bindings so far.  df None stands for the one empty row a query starts from."""

    df: DataFrame | None
    env: dict[str, Binding] = field(default_factory=dict)

    def at(self, df: DataFrame) -> Rows:
        return replace(self, df=df)

    def bind(self, **new: Binding) -> Rows:
        return replace(self, env=self.env | new)

    def bound(self, name: str, b: Binding) -> Rows:
        return replace(self, env=self.env | {name: b})


def all_of(conds: list[Column]) -> Column | None:
    out = None
    for c in conds:
        out = c if out is None else out & c
    return out


def label_test(e: Expr | None, labels: frozenset[str]) -> bool:
    if e is None:
        return True
    if e.kind == "name":
        return e.data in labels
    if e.kind == "any":
        return bool(labels)
    if e.kind == "not":
        return not label_test(e.args[0], labels)
    a, b = (label_test(x, labels) for x in e.args)
    return (a and b) if e.kind == "and" else (a or b)


def label_column(e: Expr, labels: Column) -> Column:
    """The label expression over an array column; a null array has no label."""
    if e.kind == "name":
        return F.coalesce(F.array_contains(labels, e.data), F.lit(False))
    if e.kind == "any":
        return F.coalesce(F.size(labels) > 0, F.lit(False))
    if e.kind == "not":
        return ~label_column(e.args[0], labels)
    a, b = (label_column(x, labels) for x in e.args)
    return (a & b) if e.kind == "and" else (a | b)


def uses(tree: Any) -> dict[str, set[str] | None]:
    """Of each variable named in the tree, which properties are used; None: all of it."""
    out: dict[str, set[str] | None] = {}

    def whole(v: str) -> None:
        out[v] = None

    def some(v: str, p: str | None) -> None:
        if out.get(v, set()) is not None:
            out.setdefault(v, set())
            if p:
                out[v].add(p)

    def see(x: Any) -> None:
        if isinstance(x, Expr):
            if x.kind == "prop" and isinstance(x.args[0], Expr) and x.args[0].kind == "var":
                some(x.args[0].data, x.data)
                return
            if x.kind == "var":
                whole(x.data)
                return
            ids = x.kind in ("isnull", "labeled", "end_of", "directed", "all_different") or x.kind == "agg" and x.data["name"] == "COUNT" or x.kind == "func" and x.data in ("ELEMENT_ID", "ALL_DIFFERENT", "SAME", "TYPE", "SOURCE", "DESTINATION", "CARDINALITY", "SIZE", "PATH_LENGTH")
            if x.kind == "cmp" and x.data in ("=", "<>") and all(isinstance(a, Expr) and a.kind == "var" for a in x.args):
                ids = True
            for a in x.args:
                if ids and isinstance(a, Expr) and a.kind == "var":
                    some(a.data, "@labels" if x.kind == "labeled" else None)
                else:
                    see(a)
            see(x.data) if not isinstance(x.data, (str, bytes, bool, int, float)) else None
            return
        if isinstance(x, (A.Node, A.Edge)):
            if x.var:
                for p, _ in x.props:
                    some(x.var, p)
                if x.where is not None or x.props:
                    some(x.var, None)
            see([e for _, e in x.props])
            see(x.where)
            return
        if isinstance(x, A.Return) and x.items is None:
            out["*"] = None
        if isinstance(x, A.SetItems) or isinstance(x, A.Remove):
            for i in x.items:
                whole(i[1])
        if isinstance(x, A.Pattern) and x.insertion:
            some(x.insertion, None)
        if hasattr(x, "__dataclass_fields__"):
            for f in x.__dataclass_fields__:
                see(getattr(x, f))
        elif isinstance(x, (list, tuple)):
            for y in x:
                see(y)
        elif isinstance(x, dict):
            for y in x.values():
                see(y)

    see(tree)
    return out


def pattern_vars(tree: Any) -> set[str]:
    return {x.var for x in A.walk(tree) if isinstance(x, (A.Node, A.Edge, A.Path)) and x.var}


def element_id(g: Graph, tables: tuple[str, ...], t: Column, k: Column, edges: bool = False) -> Column:
    """table:key, null for no element."""
    names = [(g.edge_no(x) if edges else g.table_no(x), x) for x in tables]
    if len(names) == 1:
        return F.when(k.isNotNull(), F.concat(F.lit(names[0][1] + ":"), k.cast("string")))
    out = None
    for no, x in names:
        one = F.concat(F.lit(x + ":"), k.cast("string"))
        out = F.when(t == no, one) if out is None else out.when(t == no, one)
    return out if out is not None else F.lit(None).cast("string")


def element_labels(g: Graph, b: Binding, df: DataFrame) -> Column:
    """A vertex's labels as an array."""
    t, k = col(f"{b.at}@t"), col(f"{b.at}@k")
    out = None
    for x in b.tables:
        v = g.vertices[g.table_no(x)]
        one = col(f"{b.at}@l") if v.dynamic else F.array(*map(F.lit, sorted(v.labels))).cast("array<string>")
        if len(b.tables) == 1:
            return F.when(k.isNotNull(), one)
        out = F.when(t == g.table_no(x), one) if out is None else out.when(t == g.table_no(x), one)
    return out if out is not None else F.lit(None).cast("array<string>")


def edge_label(g: Graph, b: Binding) -> Column:
    t = col(f"{b.at}@t")
    out = None
    for x in b.tables:
        label = g.edges[g.edge_no(x)].label
        one = F.lit(label).cast("string")
        if len(b.tables) == 1:
            return F.when(col(f"{b.at}@id").isNotNull(), one)
        out = F.when(t == g.edge_no(x), one) if out is None else out.when(t == g.edge_no(x), one)
    return out if out is not None else F.lit(None).cast("string")


def vertex_struct(g: Graph, b: Binding, df: DataFrame) -> Column:
    props = [c for c in df.columns if c.startswith(f"{b.at}@p@")]
    fields = [element_id(g, b.tables, col(f"{b.at}@t"), col(f"{b.at}@k")).alias("id"), element_labels(g, b, df).alias("labels")]
    if props:
        fields.append(F.struct(*(col(c).alias(c[len(b.at) + 3 :]) for c in props)).alias("properties"))
    return F.when(col(f"{b.at}@k").isNotNull(), F.struct(*fields))


def edge_struct(g: Graph, b: Binding, df: DataFrame) -> Column:
    props = [c for c in df.columns if c.startswith(f"{b.at}@p@")]
    everywhere = tuple(t.name for t in g.vertices)
    undirected = None
    for x in b.tables:
        one = F.lit(not g.edges[g.edge_no(x)].directed)
        undirected = F.when(col(f"{b.at}@t") == g.edge_no(x), one) if undirected is None else undirected.when(col(f"{b.at}@t") == g.edge_no(x), one)
    fields = [element_id(g, b.tables, col(f"{b.at}@t"), col(f"{b.at}@id"), True).alias("id"), element_id(g, everywhere, col(f"{b.at}@st"), col(f"{b.at}@s")).alias("src"), element_id(g, everywhere, col(f"{b.at}@dt"), col(f"{b.at}@d")).alias("dst"), edge_label(g, b).alias("label"), (undirected if undirected is not None else F.lit(False)).alias("undirected")]
    if props:
        fields.append(F.struct(*(col(c).alias(c[len(b.at) + 3 :]) for c in props)).alias("properties"))
    return F.when(col(f"{b.at}@id").isNotNull(), F.struct(*fields))


__all__ = ["Binding", "GraphQueryError", "Rows", "all_of", "col", "edge_label", "edge_struct", "element_id", "element_labels", "label_column", "label_test", "pattern_vars", "quoted", "uses", "vertex_struct"]
