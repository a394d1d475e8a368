"""Repeated parts of paths and shortest paths, by frontiers of joins."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..gql import ast as A
from ..gql.ast import Expr
from ..graph import col
from ..operators.settle import settle
from .scope import Binding, GraphQueryError, Rows, edge_struct, element_id, vertex_struct
from .substitute import replaced

LAZY_STEPS = 3  # deeper repetitions write each frontier, so that plans don't grow with depth


def renamed(x: Any, names: dict[str, str]) -> Any:
    """A pattern and its expressions over other variables."""
    x = replaced(x, lambda e: Expr("var", [], names[e.data]) if e.kind == "var" and e.data in names else None)
    return _elements(x, names)


def _elements(x: Any, names: dict[str, str]) -> Any:
    if isinstance(x, list):
        return [_elements(y, names) for y in x]
    if isinstance(x, A.Path):
        return replace(x, parts=[_elements(y, names) for y in x.parts])
    if isinstance(x, A.Group):
        return replace(x, path=_elements(x.path, names))
    if isinstance(x, A.Alternation):
        return replace(x, branches=[_elements(y, names) for y in x.branches])
    if isinstance(x, (A.Node, A.Edge)) and x.var in names:
        return replace(x, var=names[x.var])
    return x


class Paths:
    def _inner(self, group: A.Group, back: bool) -> list[Any]:
        parts = self.normalized(group.path.parts)
        if any(isinstance(x, A.Group) for x in parts):
            raise GraphQueryError("a repeated part can't hold another")
        if back:
            from .patterns import _BACK

            parts = [replace(x, direction=_BACK[x.direction]) if isinstance(x, A.Edge) else x for x in reversed(parts)]
        return parts

    def _frontier(self, rows: Rows, start: str, parts: list[Any], wanted: list[str]) -> tuple[DataFrame, str]:
        """Rows at depth 0: the vertex at hand, the path so far, and an empty list for each variable."""
        at = self.fresh("walk")
        b = rows.env[start]
        point = F.struct(col(f"{b.at}@t").cast("int").alias("t"), col(f"{b.at}@k").alias("k"))
        df = rows.df.where(col(f"{b.at}@k").isNotNull())
        df = df.withColumns({f"{at}@t": col(f"{b.at}@t").cast("int"), f"{at}@k": col(f"{b.at}@k"), f"{at}@v": F.array(point), f"{at}@e": F.array().cast("array<struct<t:int,id:bigint>>")})
        return df, at

    def _advance(self, rows: Rows, df: DataFrame, at: str, group: A.Group, parts: list[Any], wanted: dict[str, str], mode: str, cost: Expr | None = None) -> DataFrame:
        """Every way on from the frontier by one repetition."""
        names = {x.var: f" w{self.number()}" for x in parts}
        for old, new in names.items():
            if old in self.used:
                self.used[new] = self.used[old]
            if old in wanted or "*" in self.used:
                self.used[new] = None
        inner = renamed(parts, names)
        where = renamed(group.where, names) if group.where is not None else None
        if where is not None or cost is not None:
            for x in A.walk([where, renamed(cost, names) if cost is not None else None]):
                if isinstance(x, Expr) and x.kind == "var" and x.data in names.values():
                    self.used[x.data] = None
        every = tuple(t.name for t in self.graph.vertices)
        here = f" c{self.number()}"
        env = rows.env | {here: Binding("vertex", at, every, False, graph=self.graph)}
        base = df.columns
        first = inner[0]
        moved = Rows(df, env)
        moved = moved.bound(first.var, Binding("vertex", at, every, False, graph=self.graph))
        if self._must_load(first.var, first, every) or first.label is not None:
            # the vertex at hand under its own columns, so that the frontier keeps its own
            fresh = self.fresh("step")
            moved = moved.at(moved.df.withColumns({f"{fresh}@t": col(f"{at}@t"), f"{fresh}@k": col(f"{at}@k")})).bound(first.var, Binding("vertex", fresh, every, False, graph=self.graph))
            moved = self.arrived_labels(moved, first)
        for k in range(1, len(inner), 2):
            e = inner[k]
            moved = self.hop(moved, inner[k - 1].var, e, e.var, inner[k + 1].var, inner[k + 1])
        if where is not None:
            moved = self.filtered(moved, where)
        if cost is not None:
            c = self.expressions(renamed(cost, names), moved).cast("double")
            bad = c.isNull() | (c < 0) | F.isnan(c) | (c == float("inf"))
            moved = moved.at(moved.df.withColumn(f"{at}@cost", F.when(bad, F.raise_error(F.lit("a path's cost must be a number, finite and not negative")).cast("double")).otherwise(col(f"{at}@cost") + c)))
        last = moved.env[inner[-1].var]
        points = [F.struct(col(f"{moved.env[x.var].at}@t").cast("int").alias("t"), col(f"{moved.env[x.var].at}@k").alias("k")) for x in inner[2::2]]
        links = [F.struct(col(f"{moved.env[x.var].at}@t").cast("int").alias("t"), col(f"{moved.env[x.var].at}@id").alias("id")) for x in inner[1::2]]
        out = moved.df
        seen, walked = col(f"{at}@v"), col(f"{at}@e")
        if mode == "ACYCLIC":
            for i, p in enumerate(points):
                out = out.where(~F.array_contains(seen, p))
                for q in points[:i]:
                    out = out.where(p != q)
        elif mode == "SIMPLE":
            closed = (F.size(seen) > 1) & (F.get(seen, F.lit(0)) == F.get(seen, F.size(seen) - 1))
            out = out.where(~closed)
            for i, p in enumerate(points):
                again = F.array_contains(seen, p)
                out = out.where(~again | (p == F.get(seen, F.lit(0))) if i == len(points) - 1 else ~again)
        elif mode == "TRAIL":
            for i, p in enumerate(links):
                out = out.where(~F.array_contains(walked, p))
                for q in links[:i]:
                    out = out.where(p != q)
        new = {f"{at}@t": col(f"{last.at}@t").cast("int"), f"{at}@k": col(f"{last.at}@k"), f"{at}@v": F.concat(seen, F.array(*points)), f"{at}@e": F.concat(walked, F.array(*links))}
        for var, column in wanted.items():
            b = moved.env[names[var]]
            one = edge_struct(self.graph, b, moved.df) if b.kind == "edge" else vertex_struct(self.graph, b, moved.df)
            new[column] = F.concat(col(column), F.array(one)) if column in base else F.array(one)
        return out.withColumns(new).select(*(col(c) for c in dict.fromkeys([*base, *wanted.values()])))

    def arrived_labels(self, rows: Rows, node: A.Node) -> Rows:
        b = rows.env[node.var]
        rows = self.loaded(rows, node.var)
        rows = rows.bound(node.var, replace(rows.env[node.var], tables=b.tables))
        return self.bound_node(rows, node.var, node)

    def _wanted(self, parts: list[Any]) -> dict[str, str]:
        """The repeated part's variables that the query reads, with their columns."""
        return {x.var: f"{self.fresh(x.var)}@list" for x in parts if not x.var.startswith(" ") and self.reads_all(x.var)}

    def repeated(self, rows: Rows, start: str, group: A.Group, far: A.Node, back: bool, mode: str | None) -> tuple[Rows, str]:
        """{m,n} of a part of a path; paths visit no vertex twice unless another mode is asked for."""
        low, high = group.quantifier
        mode = mode or "ACYCLIC"
        if high is None and mode == "WALK":
            raise GraphQueryError("a walk without an upper bound never ends")
        parts = self._inner(group, back)
        wanted = self._wanted(parts)
        df, at = self._frontier(rows, start, parts, list(wanted))
        outs = [df] if low == 0 else []
        depth = 0
        while high is None or depth < high:
            depth += 1
            df = self._advance(rows, df, at, group, parts, wanted, mode)
            deep = high is None or high > LAZY_STEPS
            if deep:
                df = settle(df)
            if depth >= low:
                outs.append(df)
            if deep and not df.limit(1).count():
                break
        out = outs[0] if outs else df.where(F.lit(False))
        for x in outs[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        for column in wanted.values():
            out = out.withColumn(column, F.coalesce(col(column), F.array().cast(out.schema[column].dataType))) if column in out.columns else out.withColumn(column, F.array())
        if back:
            out = out.withColumns({f"{at}@v": F.reverse(col(f"{at}@v")), f"{at}@e": F.reverse(col(f"{at}@e")), **{c: F.reverse(col(c)) for c in wanted.values()}})
        kinds = {x.var: "edges" if isinstance(x, A.Edge) else "vertices" for x in parts}
        env = rows.env | {v: Binding(kinds[v], c.removesuffix("@list"), graph=self.graph) for v, c in wanted.items()}
        return self._landed(Rows(out, env), at, far), at

    def _landed(self, rows: Rows, at: str, far: A.Node) -> Rows:
        """The walk's end is the far node."""
        g = self.graph
        every = tuple(t.name for t in g.vertices)
        if far.var in rows.env:
            b = rows.env[far.var]
            rows = rows.at(rows.df.where((col(f"{at}@t") == col(f"{b.at}@t")) & (col(f"{at}@k") == col(f"{b.at}@k"))))
            return self.bound_node(rows, far.var, far)
        end = self.fresh(far.var)
        tables = self.node_tables(far.label)
        df = rows.df.withColumns({f"{end}@t": col(f"{at}@t"), f"{end}@k": col(f"{at}@k")})
        if len(tables) < len(every):
            df = df.where(col(f"{end}@t").isin(*(g.table_no(x) for x in tables)) if tables else F.lit(False))
        rows = Rows(df, rows.env | {far.var: Binding("vertex", end, tables, False, graph=g)})
        if tables and self._must_load(far.var, far, tables):
            rows = self.loaded(rows, far.var)
        return self.conditions(rows, far.var, far, self._dynamic(tables) and far.label is not None)

    def any_k(self, rows: Rows, parts: list[Any], k: int, before: set[str]) -> Rows:
        """At most k paths for each pair of ends, of the rows that were there before."""
        ends = [rows.env[parts[0].var], rows.env[parts[-1].var]]
        by = list(dict.fromkeys([c for b in ends for c in b.identity()] + [c for n in before for c in rows.env[n].identity() if n in rows.env]))
        order = [c for n, b in rows.env.items() if b.kind in ("edge", "path") for c in b.identity()] + [c for c in rows.df.columns if c.endswith("@e") or c.endswith("@v")]
        w = Window.partitionBy(*map(col, by)).orderBy(*(map(col, dict.fromkeys(order))) if order else [F.lit(0)])
        return rows.at(rows.df.withColumn("_any", F.row_number().over(w)).where(F.col("_any") <= k).drop("_any"))

    def shortest(self, rows: Rows, p: A.Path) -> Rows:
        """ANY, ALL, k or k-group shortest paths by hops, or by COST BY."""
        kind, k = p.search
        parts = self.normalized(p.parts)
        if len(parts) != 3:
            if len(parts) == 1:
                return self.path(rows, replace(p, search=None))
            raise GraphQueryError("a shortest path is one edge or one repeated part between two nodes")
        first, link, far = parts
        group = link if isinstance(link, A.Group) else A.Group(A.Path([link]), None, (1, 1))
        low, high = group.quantifier
        if first.var not in rows.env and far.var in rows.env:
            rows = self._shortest_from(rows, p, far, group, first, True, kind, k, low, high)
        else:
            rows = self._shortest_from(rows, p, first, group, far, False, kind, k, low, high)
        return rows

    def _shortest_from(self, rows: Rows, p: A.Path, start: A.Node, group: A.Group, far: A.Node, back: bool, kind: str, k: int | None, low: int, high: int | None) -> Rows:
        rows = self.bound_node(rows, start.var, start) if start.var in rows.env else self.scan(rows, start.var, start)
        parts = self._inner(group, back)
        wanted = self._wanted(parts)
        sb = rows.env[start.var]
        # paths are sought once for each start, whatever rows share it
        seeds = rows.df.select(col(f"{sb.at}@t"), col(f"{sb.at}@k")).where(col(f"{sb.at}@k").isNotNull()).distinct()
        seed_rows = Rows(seeds, {start.var: replace(sb, loaded=False)})
        df, at = self._frontier(seed_rows, start.var, parts, list(wanted))
        cost = p.cost
        if cost is not None and not any(isinstance(x, Expr) and x.kind in ("var", "prop") for x in A.walk(cost)):
            cost = None if self.expressions.constant_of(cost) >= 0 else cost  # the same for each hop: hops decide
        df = df.withColumn(f"{at}@cost", F.lit(0.0))
        by = [f"{sb.at}@t", f"{sb.at}@k", f"{at}@t", f"{at}@k"]
        order = [col(f"{at}@cost"), F.size(col(f"{at}@e")), col(f"{at}@e"), col(f"{at}@v")]

        def best(x: DataFrame, n: int) -> DataFrame:
            w = Window.partitionBy(*map(col, by)).orderBy(*order)
            return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")

        found: list[DataFrame] = [df] if low == 0 else []
        prune = low <= 1 and (kind == "ANY SHORTEST" or kind == "ALL SHORTEST" or k == 1)
        reached = settle(df.select(*map(col, by), col(f"{at}@cost").alias("_c")))
        depth = 0
        front = df
        while high is None or depth < high:
            depth += 1
            front = self._advance(seed_rows, front, at, group, parts, wanted, "ACYCLIC", cost)
            if prune:
                # a vertex reached as cheaply before needs no other path, or none but equals
                if kind != "ALL SHORTEST":
                    front = best(front, 1)
                known = reached.select(*(col(c).alias(f"_{i}") for i, c in enumerate(by)), "_c")
                same = [col(c) == F.col(f"_{i}") for i, c in enumerate(by)]
                joined = front.join(known, same[0] & same[1] & same[2] & same[3], "left")
                worse = F.col("_c").isNotNull() & ((F.col("_c") <= col(f"{at}@cost")) if cost is None or kind != "ALL SHORTEST" else (F.col("_c") < col(f"{at}@cost")))
                front = joined.where(~worse).drop("_0", "_1", "_2", "_3", "_c")
            front = settle(front)
            if not front.limit(1).count():
                break
            if prune:
                reached = settle(reached.unionByName(front.select(*map(col, by), col(f"{at}@cost").alias("_c"))).groupBy(*map(col, by)).agg(F.min("_c").alias("_c")))
            if depth >= low:
                found.append(front)
        out = found[0] if found else front.where(F.lit(False))
        for x in found[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        for column in wanted.values():
            if column in out.columns:
                out = out.withColumn(column, F.coalesce(col(column), F.array().cast(out.schema[column].dataType)))
            else:
                out = out.withColumn(column, F.array())
        rank = Window.partitionBy(*map(col, by))
        if kind == "ALL SHORTEST":
            least = F.col("_m") == (col(f"{at}@cost") if cost is not None else F.size(col(f"{at}@e")))
            out = out.withColumn("_m", F.min(col(f"{at}@cost") if cost is not None else F.size(col(f"{at}@e"))).over(rank)).where(least).drop("_m")
        else:
            out = best(out, k or 1)
        if back:
            out = out.withColumns({f"{at}@v": F.reverse(col(f"{at}@v")), f"{at}@e": F.reverse(col(f"{at}@e")), **{c: F.reverse(col(c)) for c in wanted.values()}})
        if kind == "SHORTEST GROUP":  # the k best come as one row with a list
            g = self.graph
            names, edges = tuple(t.name for t in g.vertices), tuple(t.name for t in g.edges)
            item = F.struct(col(f"{at}@cost").alias("c"), F.size(col(f"{at}@e")).alias("n"), col(f"{at}@e").alias("e"), col(f"{at}@v").alias("v"))
            out = out.groupBy(*map(col, by)).agg(F.array_sort(F.collect_list(item)).alias("_all"))
            ids = lambda x: F.struct(F.transform(x["v"], lambda y: element_id(g, names, y["t"], y["k"])).alias("vertices"), F.transform(x["e"], lambda y: element_id(g, edges, y["t"], y["id"], True)).alias("edges"))
            out = out.withColumn(f"{at}@list", F.transform("_all", ids)).drop("_all")
            wanted = {}
        paths = out.withColumnsRenamed({f"{sb.at}@t": f"{at}s@t", f"{sb.at}@k": f"{at}s@k"})
        met = rows.df.join(paths, (col(f"{sb.at}@t") == col(f"{at}s@t")) & (col(f"{sb.at}@k") == col(f"{at}s@k"))).drop(f"{at}s@t", f"{at}s@k")
        kinds = {x.var: "edges" if isinstance(x, A.Edge) else "vertices" for x in parts}
        env = rows.env | {v: Binding(kinds[v], c.removesuffix("@list"), graph=self.graph) for v, c in wanted.items()}
        landed = self._landed(Rows(met, env), at, far)
        if kind == "SHORTEST GROUP":
            return landed.bound(p.var, Binding("paths", at, graph=self.graph)) if p.var is not None else landed
        if p.var is not None:
            pat = self.fresh(p.var)
            landed = landed.at(landed.df.withColumns({f"{pat}@v": col(f"{at}@v"), f"{pat}@e": col(f"{at}@e")})).bound(p.var, Binding("path", pat, graph=self.graph))
        return landed
