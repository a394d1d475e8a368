"""Expressions as Spark columns over the bindings."""

from __future__ import annotations

import operator
from decimal import Decimal
from itertools import combinations
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from ..functions import scalars, temporal
from ..gql.ast import Expr
from ..graph import Graph, col
from .scope import Binding, GraphQueryError, Rows, edge_label, edge_struct, element_id, element_labels, label_column, label_test, vertex_struct


_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def constant(v: Any) -> Column:
    if isinstance(v, bytes):
        return F.lit(bytearray(v))
    if isinstance(v, (list, tuple)):
        return F.array(*map(constant, v))
    if isinstance(v, dict):
        return F.struct(*(constant(x).alias(k) for k, x in v.items()))
    if isinstance(v, int) and not isinstance(v, bool):
        return F.lit(v) if -(2**63) <= v < 2**63 else F.lit(Decimal(v))
    return F.lit(v)


class Expressions:
    """Compiles for one graph, its parameters and functions registered by the user."""

    def __init__(self, graph: Graph, params: dict[str, Any], session: dict[str, Any] | None = None, functions: dict | None = None):
        self.graph, self.params, self.session, self.functions = graph, params, session or {}, functions or {}

    def param(self, name: str) -> Any:
        if name not in self.params:
            raise GraphQueryError(f"parameter ${name} has no value")
        return self.params[name]

    def constant_of(self, e: Expr) -> Any:
        """The value of a literal or parameter."""
        if e.kind == "lit":
            return e.data
        if e.kind == "param":
            return self.param(e.data)
        if e.kind == "neg":
            return -self.constant_of(e.args[0])
        if e.kind == "list":
            return [self.constant_of(x) for x in e.args]
        raise GraphQueryError("a literal or parameter is needed here")

    def kind_of(self, c: Column, rows: Rows):
        return self._frame(rows).select(c).schema[0].dataType

    def _frame(self, rows: Rows):
        if rows.df is None:
            from pyspark.sql import SparkSession

            return SparkSession.active().range(1)
        return rows.df

    def binding(self, name: str, rows: Rows) -> Binding:
        if name not in rows.env:
            raise GraphQueryError(f"variable {name} is not known here")
        return rows.env[name]

    def value(self, b: Binding, rows: Rows) -> Column:
        """A binding as one column."""
        g = b.graph or self.graph
        if b.kind == "value":
            return col(b.at)
        if b.kind == "vertex":
            return vertex_struct(g, b, rows.df)
        if b.kind == "edge":
            return edge_struct(g, b, rows.df)
        if b.kind in ("vertices", "edges", "paths"):
            return col(f"{b.at}@list")
        return self.path_struct(b)

    def path_struct(self, b: Binding) -> Column:
        g = b.graph or self.graph
        names, edges = tuple(t.name for t in g.vertices), tuple(t.name for t in g.edges)
        vs = F.transform(col(f"{b.at}@v"), lambda x: element_id(g, names, x["t"], x["k"]))
        es = F.transform(col(f"{b.at}@e"), lambda x: element_id(g, edges, x["t"], x["id"], True))
        return F.when(col(f"{b.at}@v").isNotNull(), F.struct(vs.alias("vertices"), es.alias("edges")))

    def identity(self, e: Expr, rows: Rows) -> list[Column] | None:
        if e.kind == "var" and (b := self.binding(e.data, rows)).kind in ("vertex", "edge"):
            return [col(c) for c in b.identity()]
        return None

    def __call__(self, e: Expr, rows: Rows) -> Column:
        f = getattr(self, f"_{e.kind}", None)
        if f is None:
            raise GraphQueryError(f"{e.kind} can't be used here")
        return f(e, rows)

    def _lit(self, e: Expr, rows: Rows) -> Column:
        return constant(e.data)

    def _param(self, e: Expr, rows: Rows) -> Column:
        return constant(self.param(e.data))

    def _column(self, e: Expr, rows: Rows) -> Column:
        return col(e.data)

    def _var(self, e: Expr, rows: Rows) -> Column:
        return self.value(self.binding(e.data, rows), rows)

    def _prop(self, e: Expr, rows: Rows) -> Column:
        base = e.args[0]
        if base.kind == "var":
            b = self.binding(base.data, rows)
            if b.kind in ("vertex", "edge"):
                name = f"{b.at}@p@{e.data}"
                return col(name) if name in rows.df.columns else F.lit(None)
            if b.kind in ("vertices", "edges"):
                kind = self.kind_of(col(f"{b.at}@list"), rows).elementType
                inner = kind["properties"].dataType if "properties" in kind.names else StructType()
                if e.data in inner.names:
                    return F.transform(col(f"{b.at}@list"), lambda x: x["properties"][e.data])
                return F.transform(col(f"{b.at}@list"), lambda x: F.lit(None))
        c = self(base, rows)
        kind = self.kind_of(c, rows)
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            inner = kind.elementType
            if e.data in inner.names:
                return F.transform(c, lambda x: x[e.data])
            if "properties" in inner.names and e.data in inner["properties"].dataType.names:
                return F.transform(c, lambda x: x["properties"][e.data])
        if isinstance(kind, StructType):
            if e.data in kind.names:
                return c.getField(e.data)
            if "properties" in kind.names and e.data in kind["properties"].dataType.names:
                return c.getField("properties").getField(e.data)
            return F.lit(None)
        raise GraphQueryError(f"{e.data} is asked of something that has no properties")

    def _neg(self, e: Expr, rows: Rows) -> Column:
        return -self(e.args[0], rows)

    def _pos(self, e: Expr, rows: Rows) -> Column:
        return self(e.args[0], rows)

    def _arith(self, e: Expr, rows: Rows) -> Column:
        a, b = (self(x, rows) for x in e.args)
        if e.data == "+":
            if any(isinstance(self.kind_of(x, rows), (StringType, BinaryType)) for x in (a, b)):
                return F.concat(a, b)
            return a + b
        return a - b if e.data == "-" else a * b if e.data == "*" else a / b

    def _concat(self, e: Expr, rows: Rows) -> Column:
        return F.concat(*(self(x, rows) for x in e.args))

    def _cmp(self, e: Expr, rows: Rows) -> Column:
        ids = [self.identity(x, rows) for x in e.args]
        if all(ids) and e.data in ("=", "<>"):
            same = (ids[0][0] == ids[1][0]) & (ids[0][1] == ids[1][1])
            return same if e.data == "=" else ~same
        a, b = (self(x, rows) for x in e.args)
        return _COMPARE[e.data](a, b)

    def _and(self, e: Expr, rows: Rows) -> Column:
        return self(e.args[0], rows) & self(e.args[1], rows)

    def _or(self, e: Expr, rows: Rows) -> Column:
        return self(e.args[0], rows) | self(e.args[1], rows)

    def _xor(self, e: Expr, rows: Rows) -> Column:
        return self(e.args[0], rows) != self(e.args[1], rows)

    def _not(self, e: Expr, rows: Rows) -> Column:
        return ~self(e.args[0], rows)

    def _isnull(self, e: Expr, rows: Rows) -> Column:
        ids = self.identity(e.args[0], rows)
        c = (ids[1] if ids else self(e.args[0], rows)).isNull()
        return ~c if e.data else c

    def _truth(self, e: Expr, rows: Rows) -> Column:
        c = self(e.args[0], rows)
        out = c.isNull() if e.data[0] == "UNKNOWN" else c.eqNullSafe(F.lit(e.data[0] == "TRUE"))
        return ~out if e.data[1] else out

    def _in(self, e: Expr, rows: Rows) -> Column:
        out = self(e.args[0], rows).isin(*(self(x, rows) for x in e.args[1:]))
        return ~out if e.data else out

    def _in_list(self, e: Expr, rows: Rows) -> Column:
        x, items = self(e.args[0], rows), self(e.args[1], rows)
        out = F.exists(items, lambda y: y == x)
        return ~out if e.data else out

    def _strpred(self, e: Expr, rows: Rows) -> Column:
        a, b = (self(x, rows) for x in e.args)
        word, no = e.data
        out = {"STARTS": lambda: F.startswith(a, b), "ENDS": lambda: F.endswith(a, b), "CONTAINS": lambda: F.contains(a, b), "LIKE": lambda: F.like(a, b), "ILIKE": lambda: F.ilike(a, b)}[word]()
        return ~out if no else out

    def labels_of(self, b: Binding, rows: Rows, e: Expr) -> Column:
        g = b.graph or self.graph
        if b.kind == "edge":
            out = None
            for x in b.tables:
                label = g.edges[g.edge_no(x)].label
                one = F.lit(label_test(e, frozenset([label] if label else [])))
                out = F.when(col(f"{b.at}@t") == g.edge_no(x), one) if out is None else out.when(col(f"{b.at}@t") == g.edge_no(x), one)
            return F.coalesce(out, F.lit(False)) if out is not None else F.lit(False)
        fixed = [(x, label_test(e, g.vertices[g.table_no(x)].labels)) for x in b.tables if not g.vertices[g.table_no(x)].dynamic]
        if len(fixed) == len(b.tables) and len({ok for _, ok in fixed}) == 1:
            return col(f"{b.at}@k").isNotNull() & F.lit(fixed[0][1])
        labels = element_labels(g, b, rows.df)
        return col(f"{b.at}@k").isNotNull() & label_column(e, labels)

    def _labeled(self, e: Expr, rows: Rows) -> Column:
        if e.args[0].kind != "var" or (b := self.binding(e.args[0].data, rows)).kind not in ("vertex", "edge"):
            raise GraphQueryError("IS LABELED asks of a vertex or edge variable")
        out = self.labels_of(b, rows, e.data[0])
        return ~out if e.data[1] else out

    def _element(self, e: Expr, rows: Rows, *kinds: str) -> Binding:
        if e.kind != "var" or (b := self.binding(e.data, rows)).kind not in kinds:
            raise GraphQueryError(f"a variable of kind {' or '.join(kinds)} is needed")
        return b

    def _directed(self, e: Expr, rows: Rows) -> Column:
        b = self._element(e.args[0], rows, "edge")
        g = b.graph or self.graph
        yes = [g.edge_no(x) for x in b.tables if g.edges[g.edge_no(x)].directed]
        out = F.when(col(f"{b.at}@id").isNotNull(), col(f"{b.at}@t").isin(*yes) if yes else F.lit(False))
        return ~out if e.data else out

    def _end_of(self, e: Expr, rows: Rows) -> Column:
        v, b = self._element(e.args[0], rows, "vertex"), self._element(e.args[1], rows, "edge")
        t, k = ("st", "s") if e.data[0] == "src" else ("dt", "d")
        out = (col(f"{v.at}@t") == col(f"{b.at}@{t}")) & (col(f"{v.at}@k") == col(f"{b.at}@{k}"))
        return ~out if e.data[1] else out

    def _typed(self, e: Expr, rows: Rows) -> Column:
        c = self(e.args[0], rows)
        kind = self.kind_of(c, rows)
        ok = F.lit(scalars.is_type(kind, e.data[0]))
        if e.data[0].endswith("NOT NULL"):
            ok = ok & c.isNotNull()
        return ~ok if e.data[1] else ok

    def _normalized(self, e: Expr, rows: Rows) -> Column:
        out = scalars.is_normalized(self(e.args[0], rows), e.data[0])
        return ~out if e.data[1] else out

    def _normalize(self, e: Expr, rows: Rows) -> Column:
        return scalars.normalize(self(e.args[0], rows), e.data)

    def _cast(self, e: Expr, rows: Rows) -> Column:
        return scalars.cast(self(e.args[0], rows), e.data)

    def _case(self, e: Expr, rows: Rows) -> Column:
        subject, other = e.args
        out = None
        for c, then in e.data:
            test = self(c, rows) if subject is None else self._cmp(Expr("cmp", [subject, c], "="), rows)
            value = self(then, rows)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(self(other, rows)) if other is not None else out

    def _list(self, e: Expr, rows: Rows) -> Column:
        return F.array(*(self(x, rows) for x in e.args))

    def _record(self, e: Expr, rows: Rows) -> Column:
        return F.struct(*(self(x, rows).alias(n) for n, x in zip(e.data, e.args, strict=True)))

    def _index(self, e: Expr, rows: Rows) -> Column:
        items, i = (self(x, rows) for x in e.args)
        i = i.cast("int")
        return F.get(items, F.when(i < 0, F.size(items) + i).otherwise(i))

    def _slice(self, e: Expr, rows: Rows) -> Column:
        items = self(e.args[0], rows)
        n = F.size(items)
        edge = lambda x, other: other if x is None else F.when(self(x, rows) < 0, F.greatest(n + self(x, rows), F.lit(0))).otherwise(F.least(self(x, rows), n)).cast("int")
        a, b = edge(e.args[1], F.lit(0)), edge(e.args[2], n)
        return F.slice(items, a + 1, F.greatest(b - a, F.lit(0)))

    def _let_in(self, e: Expr, rows: Rows) -> Column:
        from .substitute import replaced

        body = e.args[0]
        for name, x in reversed(e.data):
            body = replaced(body, lambda y, name=name, x=x: x if y.kind == "var" and y.data == name else None)
        return self(body, rows)

    def _trim(self, e: Expr, rows: Rows) -> Column:
        s = self(e.args[0], rows)
        c = self(e.args[1], rows) if e.args[1] is not None else None
        f = {"LEADING": scalars.SIMPLE["LTRIM"], "TRAILING": scalars.SIMPLE["RTRIM"], "BOTH": scalars.SIMPLE["BTRIM"]}[e.data]
        return f(s, c) if c is not None else f(s)

    def _between(self, e: Expr, rows: Rows) -> Column:
        return temporal.between(self(e.args[0], rows), self(e.args[1], rows), e.data)

    def _path(self, e: Expr, rows: Rows) -> Column:
        g = self.graph
        vs, es = [], []
        for x in e.args:
            b = self._element(x, rows, "vertex", "edge")
            (vs if b.kind == "vertex" else es).append(element_id(g, b.tables, col(b.identity()[0]), col(b.identity()[1]), b.kind == "edge"))
        return F.struct(F.array(*vs).cast("array<string>").alias("vertices"), F.array(*es).cast("array<string>").alias("edges"))

    def _agg(self, e: Expr, rows: Rows) -> Column:
        if e.data["name"] == "SUM" and e.args[0].kind == "prop" and e.args[0].args[0].kind == "var" and self.binding(e.args[0].args[0].data, rows).kind in ("edges", "vertices"):
            items = self(e.args[0], rows)
            kind = self.kind_of(items, rows).elementType
            zero = F.lit(0).cast(kind)
            return F.aggregate(items, zero, lambda s, x: (s + F.coalesce(x, zero)).cast(kind))
        raise GraphQueryError("aggregates can only be used in what is returned")

    def _func(self, e: Expr, rows: Rows) -> Column:
        name = e.data
        args = e.args
        if name in temporal_names and len(args) == 1:
            literal = args[0].data if args[0].kind == "lit" else None
            return temporal.construct(name, self(args[0], rows), literal)
        if name in ("CARDINALITY", "SIZE"):
            if args[0].kind == "var" and (b := self.binding(args[0].data, rows)).kind == "path":
                return F.size(col(f"{b.at}@v")) + F.size(col(f"{b.at}@e"))
            c = self(args[0], rows)
            return F.when(c.isNotNull(), F.size(c)).cast("long")
        if name == "PATH_LENGTH":
            b = args[0]
            if b.kind == "var" and (p := self.binding(b.data, rows)).kind == "path":
                return F.when(col(f"{p.at}@e").isNotNull(), F.size(col(f"{p.at}@e"))).cast("long")
            return F.size(self(b, rows).getField("edges")).cast("long")
        if name in ("NODES", "EDGES", "ELEMENTS"):
            c = self(args[0], rows)
            if name == "NODES":
                return c.getField("vertices")
            if name == "EDGES":
                return c.getField("edges")
            pairs = F.zip_with(c.getField("vertices"), c.getField("edges"), lambda a, b: F.array(a, b))
            return F.filter(F.flatten(pairs), lambda x: x.isNotNull())
        if name == "ELEMENT_ID":
            b = self._element(args[0], rows, "vertex", "edge")
            return element_id(b.graph or self.graph, b.tables, *(col(c) for c in b.identity()), b.kind == "edge")
        if name in ("LABELS", "LABEL"):
            b = self._element(args[0], rows, "vertex", "edge")
            if b.kind == "edge":
                one = edge_label(b.graph or self.graph, b)
                return one if name == "LABEL" else F.when(one.isNotNull(), F.array(one))
            labels = element_labels(b.graph or self.graph, b, rows.df)
            if name == "LABELS":
                return labels
            return F.when(F.size(labels) == 1, F.get(labels, F.lit(0))).when(labels.isNotNull(), F.raise_error(F.lit("LABEL needs exactly one label")).cast("string"))
        if name == "TYPE":
            return edge_label(self.graph, self._element(args[0], rows, "edge"))
        if name in ("SOURCE", "DESTINATION"):
            b = self._element(args[0], rows, "edge")
            g = b.graph or self.graph
            t, k = ("st", "s") if name == "SOURCE" else ("dt", "d")
            return element_id(g, tuple(x.name for x in g.vertices), col(f"{b.at}@{t}"), col(f"{b.at}@{k}"))
        if name in ("ALL_DIFFERENT", "SAME"):
            ids = [self.identity(x, rows) for x in args]
            if not all(ids):
                raise GraphQueryError(f"{name} compares vertex or edge variables")
            out = F.lit(True)
            for a, b in combinations(ids, 2):
                same = (a[0] == b[0]) & (a[1] == b[1])
                out = out & (same if name == "SAME" else ~same)
            return out
        if name == "PROPERTY_EXISTS":
            return self._prop(Expr("prop", [args[0]], args[1].data), rows).isNotNull()
        if name in scalars.SESSION:
            return F.lit(self.session.get("user"))
        short = ".".join(name.split(".")[-2:])
        if short in scalars.VECTOR:
            one = [self._vector(x, rows) for x in args]
            return scalars.VECTOR[short](*one)
        if name in scalars.SIMPLE:
            try:
                return scalars.SIMPLE[name](*(self(x, rows) for x in args))
            except TypeError as err:
                raise GraphQueryError(f"{name}: wrong number of arguments") from err
        if name in self.functions:
            return self.functions[name](*(self(x, rows) for x in args))
        raise GraphQueryError(f"function {name} is not known")

    def _vector(self, e: Expr, rows: Rows) -> Column:
        """A vector: a list, or the only list property of an edge or vertex."""
        if e.kind == "var" and (b := self.binding(e.data, rows)).kind in ("edge", "vertex"):
            lists = [f.name for f in rows.df.schema if f.name.startswith(f"{b.at}@p@") and isinstance(f.dataType, ArrayType)]
            if len(lists) != 1:
                raise GraphQueryError(f"{e.data} has {len(lists)} list properties; name one")
            return col(lists[0])
        return self(e, rows)


temporal_names = {"DATE", "TIME", "LOCAL_TIME", "ZONED_TIME", "DATETIME", "LOCAL_DATETIME", "ZONED_DATETIME", "TIMESTAMP", "DURATION"}
