"""Entry point: graphs in a catalog, queries in text, results as DataFrames."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .gql import ast as A
from .gql.parser import parse
from .graph import Catalog, Graph
from .plans import changes, ddl
from .plans.compiler import Compiler
from .plans.explain import explain_block
from .plans.scope import GraphQueryError
from .plans.validate import validate


class Engine:
    """Runs programs.  params are bound as literals, so filters on them reach the scans."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, name: str = "default", user: str | None = None):
        self.spark, self.catalog, self.current = spark, Catalog(), name
        self.catalog.graphs[name] = graph or Graph()
        self.session: dict[str, Any] = {"user": user, "params": {}}
        self.functions: dict[str, Callable] = {}
        self.procedures: dict[str, Callable] = {}
        self.prepared: dict[str, tuple[list, list[str]]] = {}
        self._before: tuple | None = None

    @property
    def graph(self) -> Graph:
        return self.catalog.graph(self.current)

    def register(self, name: str, function: Callable) -> None:
        """A function of columns, called by name in queries."""
        self.functions[name.upper()] = function

    def register_procedure(self, name: str, function: Callable) -> None:
        """A function of (compiler, *arguments) that returns a DataFrame, for CALL."""
        self.procedures[name.upper()] = function

    def _compiler(self, params: dict[str, Any] | None) -> Compiler:
        return Compiler(self.spark, self.catalog, self.graph, self.session["params"] | (params or {}), self.session, self.functions, self.procedures)

    def _run(self, blocks: list[A.Block], params: dict[str, Any] | None) -> DataFrame | None:
        out = None
        for b in blocks:
            if len(b.statements) == 1 and isinstance(b.statements[0], A.Catalog):
                out = ddl.run(self, b.statements[0], self._compiler(params))
                continue
            validate(b)
            if changes.is_change(b):
                new, out = changes.run(self._compiler(params), b)
                self.catalog.graphs[self.current] = new
            else:
                out = self._compiler(params).program(b)
        return out

    def execute(self, text: str, params: dict[str, Any] | None = None) -> DataFrame | None:
        """Run a program; the last statement's result."""
        return self._run(parse(text), params)

    def gql(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Run a query, which must not change anything."""
        blocks = parse(text)
        if any(changes.is_change(b) or isinstance(s, A.Catalog) for b in blocks for s in b.statements):
            raise GraphQueryError("this changes graphs or the catalog; use execute()")
        out = self._run(blocks, params)
        assert out is not None
        return out

    def begin(self) -> None:
        """All of the catalog and the session can come back; graphs themselves never change."""
        self._before = copy.deepcopy({k: v for k, v in vars(self.catalog).items() if k != "graphs"}), dict(self.catalog.graphs), copy.deepcopy(self.session), self.current

    def rollback(self) -> None:
        if self._before is not None:
            rest, graphs, self.session, self.current = self._before
            vars(self.catalog).update(rest, graphs=graphs)
            self._before = None

    def commit(self) -> None:
        self._before = None

    # prepared queries
    def prepare(self, name: str, text: str, sorts: list[str] | None = None) -> None:
        """Parse once; sorts are the ORDER BY clauses a caller may choose from."""
        blocks = parse(text)
        for b in blocks:
            validate(b)
        for s in sorts or []:
            parse(f"RETURN 1 AS x ORDER BY {s}")
        self.prepared[name] = (blocks, list(sorts or []))

    def run(self, name: str, params: dict[str, Any] | None = None, sort: str | None = None) -> DataFrame | None:
        if name not in self.prepared:
            raise KeyError(f"no query is prepared as {name}")
        blocks, sorts = self.prepared[name]
        if sort is None:
            return self._run(blocks, params)
        if sort not in sorts:
            raise GraphQueryError(f"{name} can't be sorted by {sort}")
        order = parse(f"RETURN 1 AS x ORDER BY {sort}")[0].statements[0].first.clauses[-1].order
        last = blocks[-1].statements[-1]
        tail = last.first.clauses[-1]
        before, tail.order = tail.order, order
        try:
            return self._run(blocks, params)
        finally:
            tail.order = before

    def drop_prepared(self, name: str) -> None:
        del self.prepared[name]

    def list_prepared(self) -> list[str]:
        return sorted(self.prepared)

    def explain(self, text: str, params: dict[str, Any] | None = None) -> str:
        """The steps of a query and Spark's plan for them."""
        blocks = parse(text)
        lines = []
        for b in blocks:
            lines += explain_block(b)
            if not changes.is_change(b) and not isinstance(b.statements[0], A.Catalog):
                df = self._compiler(params).program(b)
                lines.append(df._jdf.queryExecution().simpleString())
        return "\n".join(lines)

    # direct lookups, each one filter, so that it reaches the scan
    def lookup_equal(self, label: str, prop: str, value: Any) -> DataFrame:
        return self.gql(f'MATCH (v:"{label}" {{"{prop}": $value}}) RETURN v', {"value": value})

    def lookup_range(self, label: str, prop: str, low: Any = None, high: Any = None) -> DataFrame:
        """low <= value < high; None leaves a side open."""
        return self.gql(f'MATCH (v:"{label}") WHERE ($low IS NULL OR v."{prop}" >= $low) AND ($high IS NULL OR v."{prop}" < $high) RETURN v', {"low": low, "high": high})

    def lookup_intersection(self, label: str, **equal: Any) -> DataFrame:
        cond = " AND ".join(f'v."{p}" = ${p}' for p in equal)
        return self.gql(f'MATCH (v:"{label}") WHERE {cond} RETURN v', equal)

    def count_by_value(self, label: str, prop: str) -> DataFrame:
        return self.gql(f'MATCH (v:"{label}") RETURN v."{prop}" AS value, COUNT(*) AS n GROUP BY v."{prop}"')

    def filter_hits(self, hits: DataFrame, label: str, prop: str, value: Any) -> DataFrame:
        """The rows of hits (id: element ids) whose vertex has the value."""
        found = self.gql(f'MATCH (v:"{label}" {{"{prop}": $value}}) RETURN ELEMENT_ID(v) AS id', {"value": value})
        return hits.join(found, "id", "left_semi")

    def lookup_edge_equal(self, label: str, prop: str, value: Any) -> DataFrame:
        return self.gql(f'MATCH -[e:"{label}" {{"{prop}": $value}}]-> RETURN e', {"value": value})

    def vector_search(self, index: str, query: list[float], k: int) -> DataFrame:
        v = self.catalog.vectors[index]
        out = "SCORE" if v.metric == "cosine" else "DISTANCE"
        return self.gql(f'SEARCH v IN (VECTOR INDEX "{index}" FOR $q LIMIT $k) {out} AS d RETURN ELEMENT_ID(v) AS id, d', {"q": query, "k": k})
