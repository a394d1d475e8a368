"""Queries: clauses in turn extend, filter, group and order the bindings; subqueries are joined on what they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..gql import ast as A
from ..gql.ast import Expr
from ..gql.formatter import expression
from ..graph import Catalog, Graph, col
from ..operators.aggregates import aggregate, ordering
from ..operators.sets import combine
from ..operators.vectors import nearest
from .counting import Counting
from .expressions import Expressions
from .patterns import Patterns
from .scope import Binding, GraphQueryError, Rows, all_of, uses
from .substitute import replaced


EXACT_IN_DOUBLE = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


def has_aggregate(e: Any, over_list: Callable[[Expr], bool] = lambda e: False) -> bool:
    """Whether an aggregate of this level is in e; those of subqueries, and sums over lists, are no such."""
    if isinstance(e, Expr):
        if e.kind == "agg":
            return not over_list(e)
        if e.kind in ("exists", "value"):
            return False
        return any(has_aggregate(x, over_list) for x in e.args) or e.kind in ("case", "let_in") and any(has_aggregate(y, over_list) for pair in e.data for y in pair)
    return False


class Compiler(Counting, Patterns):
    def __init__(self, spark: SparkSession, catalog: Catalog, graph: Graph, params: dict[str, Any], session: dict[str, Any] | None = None, functions: dict | None = None, procedures: dict[str, Callable] | None = None):
        self.spark, self.catalog, self.graph, self.params = spark, catalog, graph, params
        self.session, self.functions, self.procedures = session or {}, functions or {}, procedures or {}
        self.used: dict[str, set[str] | None] = {}
        self._n = 0

    @property
    def expressions(self) -> Expressions:
        return Expressions(self.graph, self.params, self.session, self.functions)

    def number(self) -> int:
        self._n += 1
        return self._n

    def fresh(self, name: str) -> str:
        return f"{name.strip()}#{self.number()}"

    def unit(self) -> DataFrame:
        return self.spark.range(1).select()

    # statements
    def program(self, block: A.Block) -> DataFrame:
        self.used = uses(block)
        rows = self.block(block, Rows(None))
        return self.output(rows)

    def output(self, rows: Rows) -> DataFrame:
        df = self.frame(rows)
        e = self.expressions
        return df.select(*(e.value(b, rows).alias(n) for n, b in rows.env.items() if not n.startswith(" ")))

    def block(self, block: A.Block, rows: Rows, keep: list[str] | None = None) -> Rows:
        """keep: columns of an outer row that every row carries along, by which it counts, groups and orders apart."""
        for name, x in block.bindings:
            rows = self.let(rows, name, x)
        for k, s in enumerate(block.statements):
            if isinstance(s, A.Catalog):
                raise GraphQueryError("a catalog statement can't be part of a query")
            rows = self.composite(s, rows, keep or [])
            if k + 1 < len(block.statements):
                ys = block.yields[k + 1]
                if ys is not None:
                    for a, _ in ys:
                        self.expressions.binding(a, rows)
                    rows = Rows(rows.df, {n: rows.env[a] for a, n in ys})
        return rows

    def composite(self, c: A.Composite, rows: Rows, keep: list[str]) -> Rows:
        out = self.linear(c.first, rows, keep)
        if not c.rest:
            return out
        plain = lambda r: self.frame(r).select(*map(col, keep), *(self.expressions.value(b, r).alias(n) for n, b in r.env.items() if not n.startswith(" ")))
        df, names = plain(out), [n for n in out.env if not n.startswith(" ")]
        for op, every, q in c.rest:
            other = self.linear(q, rows, keep)
            try:
                if op == "OTHERWISE" and keep:
                    mine = df.select(*map(col, keep)).distinct()
                    df = df.unionByName(plain(other).join(mine, [df_eq(k, mine, plain(other)) for k in keep], "left_anti"))
                else:
                    df = combine(op, every, df, plain(other))
            except ValueError as e:
                raise GraphQueryError(str(e)) from None
        return Rows(df, {n: Binding("value", n) for n in names})

    def linear(self, q: A.Linear, rows: Rows, keep: list[str]) -> Rows:
        graph, before = self.graph, (self.counts, self.times)
        clauses = list(q.clauses)
        self.counts, self.times = self.only_counts(clauses, rows, keep), None
        if self.counts:
            clauses = self.pieces(clauses)
        try:
            for i, c in enumerate(clauses):
                nxt = clauses[i + 1] if i + 1 < len(clauses) else None
                if isinstance(c, A.Page) and isinstance(nxt, A.Page):  # OFFSET then LIMIT as clauses of their own
                    clauses[i + 1] = A.Page(c.offset or nxt.offset, c.limit or nxt.limit)
                    continue
                if isinstance(c, A.OrderBy):
                    keys = self.sort_keys(rows, c)
                    if isinstance(nxt, A.Page):
                        clauses[i + 1] = (c, nxt)
                        continue
                    rows = rows.at(self.frame(rows).orderBy(*keys))
                elif isinstance(c, tuple):
                    rows = rows.at(self.paged(self.frame(rows), c[1], self.sort_keys(rows, c[0]), keep))
                elif isinstance(c, A.Page):
                    rows = rows.at(self.paged(self.frame(rows), c, None, keep))
                elif self.counts and isinstance(c, A.Match):
                    counted = self.counted_optional(c, rows, nxt) if c.optional and isinstance(nxt, A.Return) else None
                    rows = counted or self.clause(c, rows, keep)
                    rows = self.folded(rows, clauses[: i + 1], clauses[i + 1 :])
                else:
                    rows = self.clause(c, rows, keep)
        finally:
            self.graph, (self.counts, self.times) = graph, before
        return rows

    def clause(self, c: Any, rows: Rows, keep: list[str]) -> Rows:
        if isinstance(c, A.Use):
            self.graph = self.catalog.graph(c.graph)
            return rows
        if isinstance(c, A.Match):
            return self.optional(c, rows) if c.optional else self.match(rows, c.pattern)
        if isinstance(c, A.Filter):
            return self.filtered(rows, c.cond)
        if isinstance(c, A.Let):
            for name, e in c.items:
                rows = self.let(rows, name, e)
            return rows
        if isinstance(c, A.For):
            return self.unnest(c, rows)
        if isinstance(c, A.Call):
            return self.call(c, rows)
        if isinstance(c, A.CallProcedure):
            return self.procedure(c, rows)
        if isinstance(c, A.Search):
            return self.search(c, rows)
        if isinstance(c, A.Finish):
            return Rows(self.frame(rows).where(F.lit(False)), {})
        if isinstance(c, A.Return):
            return self.returned(c, rows, keep)
        raise GraphQueryError(f"{type(c).__name__} changes a graph; run it by execute()")

    # rows
    def let(self, rows: Rows, name: str, e: Expr) -> Rows:
        if e.kind == "var" and e.data in rows.env:
            return rows.bound(name, rows.env[e.data])
        rows, e, extra = self.lifted(rows, e)
        at = self.fresh(name)
        df = self.frame(rows)
        df = df.withColumn(at, self.expressions(e, rows if rows.df is not None else rows.at(df)))
        return rows.at(df.drop(*extra)).bound(name, Binding("value", at))

    def unnest(self, c: A.For, rows: Rows) -> Rows:
        rows, e, extra = self.lifted(rows, c.source)
        at, pos = self.fresh(c.var), self.fresh(c.counter or "i")
        df = self.frame(rows)
        items = self.expressions(e, rows if rows.df is not None else rows.at(df))
        df = df.select("*", F.posexplode(items).alias(pos, at)).drop(*extra)
        rows = rows.at(df).bound(c.var, Binding("value", at))
        if c.counter:
            rows = rows.at(rows.df.withColumn(pos, col(pos).cast("long") + (1 if c.one_based else 0))).bound(c.counter, Binding("value", pos))
        else:
            rows = rows.at(rows.df.drop(pos))
        return rows

    def sort_keys(self, rows: Rows, o: A.OrderBy) -> list[Column]:
        keys = []
        for e, up, nulls in o.items:
            ids = self.expressions.identity(e, rows)
            for c in ids or [self.expressions(e, rows)]:
                keys.append((c, up, nulls))
        return ordering(keys)

    def count_of(self, e: Expr | None, what: str) -> int | None:
        if e is None:
            return None
        n = self.expressions.constant_of(e)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise GraphQueryError(f"{what} must be a whole number that isn't negative, not {n!r}")
        return n

    def paged(self, df: DataFrame, p: A.Page, keys: list[Column] | None, keep: list[str]) -> DataFrame:
        offset, limit = self.count_of(p.offset, "OFFSET"), self.count_of(p.limit, "LIMIT")
        if keep:  # for each outer row on its own
            w = Window.partitionBy(*map(col, keep)).orderBy(*(keys or [F.lit(0)]))
            n = F.col("_page")
            df = df.withColumn("_page", F.row_number().over(w)).where(n > (offset or 0))
            if limit is not None:
                df = df.where(n <= (offset or 0) + limit)
            return df.drop("_page")
        if keys:
            df = df.orderBy(*keys)
        if offset:
            df = df.offset(offset)
        return df.limit(limit) if limit is not None else df

    # subqueries
    def shared(self, rows: Rows, tree: Any, scope: list[str] | None = None) -> tuple[list[str], dict[str, Binding]]:
        """The columns of outer variables that a subquery reads, and those variables."""
        named = uses(tree)
        from .scope import pattern_vars

        names = [n for n in rows.env if (scope is None or n in scope) and (n in named or n in pattern_vars(tree))]
        cols: list[str] = []
        for n in names:
            b = rows.env[n]
            cols += b.identity()
            props = named.get(n, set())
            have = b.columns(rows.df) if rows.df is not None else []
            if props is None:
                cols += have
            else:
                cols += [c for c in have if c in {f"{b.at}@p@{p}" for p in props} or c == f"{b.at}@l"]
        cols = [c for c in dict.fromkeys(cols) if rows.df is not None and c in rows.df.columns]
        return cols, {n: rows.env[n] for n in names}

    def seeds(self, rows: Rows, tree: Any, scope: list[str] | None = None) -> tuple[Rows, list[str], dict[str, str]]:
        """The distinct outer values a subquery starts from, under new column names."""
        cols, env = self.shared(rows, tree, scope)
        if not cols:
            return Rows(None, {n: b for n, b in env.items()}), [], {}
        news: dict[str, Binding] = {}
        names: dict[str, str] = {}
        named = uses(tree)
        for n, b in env.items():
            at = self.fresh("outer")
            for c in cols:
                if c == b.at or c.startswith(b.at + "@"):
                    names.setdefault(c, at + c[len(b.at) :])
            prefix = next((names[c][: len(names[c]) - len(c[len(b.at) :])] for c in cols if c == b.at or c.startswith(b.at + "@")), at)
            read = named.get(n, set())
            news[n] = replace(b, at=prefix, loaded=b.loaded or read is not None and not read)  # what isn't read needn't be loaded
        df = rows.df.select(*(col(c).alias(names[c]) for c in cols)).distinct()
        return Rows(df, news), [names[c] for c in cols], names

    def joined_back(self, rows: Rows, sub: DataFrame, names: dict[str, str], how: str) -> DataFrame:
        df = self.frame(rows)
        if not names:
            if how == "left":
                return df.join(sub, F.lit(True), "left")
            return df.crossJoin(sub)
        cond = all_of([col(a).eqNullSafe(col(b)) for a, b in names.items()])
        return df.join(sub, cond, how).drop(*names.values())

    def optional(self, c: A.Match, rows: Rows) -> Rows:
        """Rows without a match stay, with nulls for the new variables."""
        block = c.block if c.block is not None else [replace(c, optional=False)]
        if rows.df is None:
            rows = rows.at(self.unit().withColumn("_unit", F.lit(1)))
        start, keep, names = self.seeds(rows, block)
        out = start
        for m in block:
            out = self.clause(m, out, [])
        new = {n: b for n, b in out.env.items() if n not in rows.env and not n.startswith(" ")}
        for n in new:
            if new[n].kind == "vertex" and not new[n].loaded and self.needs(n):
                out = self.loaded(out, n)
                new[n] = out.env[n]
        cols = [c for b in new.values() for c in b.columns(out.df)]
        sub = out.df.select(*(col(x) for x in dict.fromkeys([*keep, *cols])))
        df = self.joined_back(rows, sub, names, "left")
        return Rows(df.drop("_unit") if "_unit" in df.columns and not rows.env else df, rows.env | new)

    def call(self, c: A.Call, rows: Rows) -> Rows:
        """A subquery for each row, with the variables in scope; OPTIONAL keeps rows without result."""
        start, keep, names = self.seeds(rows, c.query, c.scope) if rows.df is not None else (Rows(None), [], {})
        sub = self.block(c.query, start, keep)
        new = {n: b for n, b in sub.env.items() if not n.startswith(" ") and not (n in rows.env and n in start.env)}
        clash = [n for n in new if n in rows.env]
        if clash:
            raise GraphQueryError(f"{clash[0]} is bound outside the call already")
        frame = self.frame(sub)
        cols = {c: self.fresh("call") for b in new.values() for c in b.columns(frame)}
        env = {}
        for n, b in new.items():
            at = self.fresh(n)
            env[n] = replace(b, at=at)
            cols |= {x: at + x[len(b.at) :] for x in b.columns(frame)}
        frame = frame.select(*map(col, keep), *(col(a).alias(b) for a, b in cols.items()))
        return Rows(self.joined_back(rows, frame, names, "left" if c.optional else "inner"), rows.env | env)

    def lifted(self, rows: Rows, e: Expr) -> tuple[Rows, Expr, list[str]]:
        """EXISTS and VALUE subqueries of an expression, joined on as columns."""
        found: list[tuple[Expr, str]] = []

        def see(x: Expr) -> Expr | None:
            if x.kind in ("exists", "value"):
                at = self.fresh(x.kind)
                found.append((x, at))
                return Expr("column", [], at)
            return None

        e = replaced(e, see)
        for x, at in found:
            if rows.df is None:
                rows = rows.at(self.unit().withColumn(self.fresh("unit"), F.lit(1)))
            start, keep, names = self.seeds(rows, x.data)
            sub = self.block(x.data, start, keep)
            frame = self.frame(sub)
            if x.kind == "exists":
                flags = frame.select(*map(col, keep)).distinct().withColumn(at, F.lit(True)) if keep else frame.limit(1).agg((F.count(F.lit(1)) > 0).alias(at))
                df = self.joined_back(rows, flags if keep else F.broadcast(flags), names, "left")
                rows = rows.at(df.withColumn(at, F.coalesce(col(at), F.lit(False))))
            else:
                values = [b for n, b in sub.env.items() if n not in start.env]
                if len(values) != 1:
                    raise GraphQueryError("VALUE needs a query of one column")
                one = self.expressions.value(values[0], sub)
                n = F.count(F.lit(1))
                value = F.when(n <= 1, F.first(one)).otherwise(F.raise_error(F.lit("VALUE found more than one row")))
                grouped = frame.groupBy(*map(col, keep)).agg(value.alias(at)) if keep else frame.agg(value.alias(at))
                rows = rows.at(self.joined_back(rows, grouped, names, "left"))
        return rows, e, [at for _, at in found]

    def procedure(self, c: A.CallProcedure, rows: Rows) -> Rows:
        f = self.procedures.get(c.name.upper())
        if f is None and c.name.upper().rpartition(".")[2].startswith(("FINALIZE_", "DRAIN_")):
            return self.maintenance(c, rows)
        if f is None:
            raise GraphQueryError(f"procedure {c.name} is not known")
        df = f(self, *(self.expressions.constant_of(x) for x in c.args))
        ys = c.yields or [(n, n) for n in df.columns]
        at = {n: self.fresh(n) for _, n in ys}
        df = df.select(*(col(a).alias(at[n]) for a, n in ys))
        out = df if rows.df is None else rows.df.join(df, F.lit(True), "left") if c.optional else rows.df.crossJoin(df)
        return Rows(out, rows.env | {n: Binding("value", at[n]) for _, n in ys})

    def maintenance(self, c: A.CallProcedure, rows: Rows) -> Rows:
        """Finalizing and draining have nothing to do, as Spark keeps no deferred work: counters of 0 under the names asked for."""
        at = {n: self.fresh(n) for _, n in c.yields or [("processed", "processed")]}
        df = self.frame(rows).withColumns({x: F.lit(0).cast("long") for x in at.values()})
        return Rows(df, rows.env | {n: Binding("value", x) for n, x in at.items()})

    def search(self, c: A.Search, rows: Rows) -> Rows:
        """The index's k nearest vertices, found before anything is joined, then joined with the rows."""
        index = self.catalog.vectors.get(c.index)
        if index is None:
            raise GraphQueryError(f"no vector index is named {c.index}")
        if (c.output == "SCORE") != (index.metric == "cosine"):
            raise GraphQueryError(f"a {index.metric} index gives a {'SCORE' if index.metric == 'cosine' else 'DISTANCE'}")
        k = self.count_of(c.limit, "LIMIT")
        if not 1 <= k <= 1024:
            raise GraphQueryError("a search finds 1 to 1024 vertices")
        query = self.expressions.constant_of(c.query)
        node = A.Node(c.var, Expr("name", [], index.label), where=c.where)
        before, self.used = self.used, self.used | {c.var: None}
        found = self.scan(Rows(None), c.var, node)
        self.used = before
        b = found.env[c.var]
        score = self.fresh(c.alias)
        top = nearest(found.df, col(f"{b.at}@p@{index.prop}"), query, index.metric, index.dims, k, [col(f"{b.at}@t"), col(f"{b.at}@k")], score, index.encoding)
        if c.var in rows.env:
            o = rows.env[c.var]
            slim = top.select(col(f"{b.at}@t").alias("_t"), col(f"{b.at}@k").alias("_k"), col(score))
            df = rows.df.join(F.broadcast(slim), (col(f"{o.at}@t") == F.col("_t")) & (col(f"{o.at}@k") == F.col("_k"))).drop("_t", "_k")  # at most 1024 rows
            return rows.at(df).bound(c.alias, Binding("value", score))
        df = top if rows.df is None else rows.df.crossJoin(F.broadcast(top))
        return Rows(df, rows.env | {c.var: b, c.alias: Binding("value", score)})

    # results
    def returned(self, r: A.Return, rows: Rows, keep: list[str]) -> Rows:
        if r.source is not None:
            rows = self.selected_from(r, rows, keep)
        if r.no_bindings:
            return Rows(self.frame(rows), {})
        items = r.items
        if items is None:
            items = [(Expr("var", [], n), n) for n in rows.env if not n.startswith(" ")]
            if not items and rows.df is None:
                raise GraphQueryError("there is nothing to return")
        names = self.output_names(items)
        items = list(zip([e for e, _ in items], names, strict=True))
        lists = lambda x: self._horizontal(x, rows)
        grouping = r.group_by is not None or any(has_aggregate(e, lists) for e, _ in items) or r.having is not None and has_aggregate(r.having, lists) or bool(r.order and any(has_aggregate(e, lists) for e, _, _ in r.order.items))
        alias = {n: e for e, n in items}
        expand = lambda e: replaced(e, lambda y: alias[y.data] if y.kind == "var" and y.data in alias and y.data not in rows.env else None)
        having = expand(r.having) if r.having is not None else None
        order = [(expand(e), up, nulls) for e, up, nulls in r.order.items] if r.order else []
        if grouping:
            rows, swap = self.grouped(rows, items, [expand(e) for e in r.group_by] if r.group_by is not None else None, having, order, keep)
            items = [(swap(e), n) for e, n in items]
            having = swap(having) if having is not None else None
            order = [(swap(e), up, nulls) for e, up, nulls in order]
        if having is not None:
            rows = self.filtered(rows, having)
        out_env: dict[str, Binding] = {}
        df = self.frame(rows)
        rows = rows.at(df)
        extra: list[str] = []
        new: dict[str, Column] = {}
        for e, n in items:
            if e.kind == "var" and e.data in rows.env:
                out_env[n] = rows.env[e.data]
                continue
            rows, e, _ = self.lifted(rows, e)
            at = self.fresh(n)
            new[at] = self.expressions(e, rows)
            out_env[n] = Binding("value", at)
        rows = rows.at(rows.df.withColumns(new)) if new else rows
        keys = None
        if order:
            ready = []
            for e, up, nulls in order:
                same = next((n for x, n in items if x == e and out_env[n].kind == "value"), None)
                if same:
                    ready.append((Expr("column", [], out_env[same].at), up, nulls))
                else:
                    rows, e, _ = self.lifted(rows, e)
                    ready.append((e, up, nulls))
            keys = self.sort_keys(rows, A.OrderBy(ready))
        for n, b in list(out_env.items()):
            if b.kind == "vertex" and not b.loaded and self.needs(n):
                rows = self.loaded(rows.bound(n, b), n)
                out_env[n] = rows.env[n]
        if r.distinct:
            cols = list(dict.fromkeys([*keep, *(c for b in out_env.values() for c in b.columns(rows.df))]))
            hidden = {}
            if keys:
                for i, (e, _, _) in enumerate(ready):
                    c = self.expressions(e, rows)
                    hidden[f"_key{i}"] = c
                rows = rows.at(rows.df.withColumns(hidden))
                ready = [(Expr("column", [], f"_key{i}"), up, nulls) for i, (_, up, nulls) in enumerate(ready)]
            ids = [*keep, *(c for b in out_env.values() for c in (b.identity() if b.kind in ("vertex", "edge") else b.columns(rows.df)))]
            slim = rows.df.select(*(col(c) for c in [*cols, *hidden]))
            simple = all(b.kind not in ("vertex", "edge") for b in out_env.values()) and not hidden
            rows = rows.at(slim.distinct() if simple else slim.groupBy(*(col(c) for c in dict.fromkeys(ids))).agg(*(F.first(col(c)).alias(c) for c in [*cols, *hidden] if c not in ids)))
            if keys:
                keys = self.sort_keys(rows, A.OrderBy(ready))
        df = rows.df
        if r.page:
            df = self.paged(df, r.page, keys, keep)
        elif keys:
            df = df.orderBy(*keys)
        cols = list(dict.fromkeys([*keep, *(c for b in out_env.values() for c in b.columns(df))]))
        return Rows(df.select(*map(col, cols)) if cols else df, out_env)

    def output_names(self, items: list[tuple[Expr, str | None]]) -> list[str]:
        names: list[str] = []
        for e, alias in items:
            if alias in names:
                raise GraphQueryError(f"two columns are named {alias}")
            n = alias or (e.data if e.kind == "var" else expression(e) if e.kind == "prop" and e.args[0].kind == "var" else "expr")
            base, k = n, 2
            while n in names:
                n, k = f"{base}_{k}", k + 1
            names.append(n)
        return names

    def selected_from(self, r: A.Return, rows: Rows, keep: list[str]) -> Rows:
        for graph, source in r.source:
            before = self.graph
            if graph:
                self.graph = self.catalog.graph(graph)
            if isinstance(source, A.Match):
                rows = self.match(rows, source.pattern)
            else:
                rows = self.call(A.Call(source, None), rows) if rows.df is not None else self.block(source, rows, keep)
            if graph and len(r.source) > 1:
                self.graph = before
        return self.filtered(rows, r.where) if r.where is not None else rows

    def grouped(self, rows: Rows, items: list, group_by: list[Expr] | None, having: Expr | None, order: list, keep: list[str]) -> tuple[Rows, Callable[[Expr], Expr]]:
        """Rows of groups, and how expressions over the ungrouped rows read them."""
        exprs = [e for e, _ in items] + ([having] if having is not None else []) + [e for e, _, _ in order]
        if rows.df is None:
            rows = rows.at(self.unit())
        keys: dict[str, Column] = {c: col(c) for c in keep}
        carried: dict[str, Column] = {}
        env: dict[str, Binding] = {}
        swaps: list[tuple[Expr, Expr]] = []
        for e in group_by or []:
            if e.kind == "var" and (b := self.expressions.binding(e.data, rows)).kind in ("vertex", "edge", "path"):
                if b.kind == "vertex" and not b.loaded and self.needs(e.data):
                    rows = self.loaded(rows, e.data)
                    b = rows.env[e.data]
                for c in b.columns(rows.df):
                    (keys if c in b.identity() else carried)[c] = col(c)
                env[e.data] = b
            elif e.kind == "var":
                keys[rows.env[e.data].at] = col(rows.env[e.data].at)
                env[e.data] = rows.env[e.data]
            else:
                at = self.fresh("key")
                rows, x, _ = self.lifted(rows, e)
                keys[at] = self.expressions(x, rows)
                swaps.append((e, Expr("column", [], at)))
        aggs: list[tuple[Expr, str]] = []

        def collect(e: Any) -> None:
            if isinstance(e, Expr):
                if any(e == k for k, _ in swaps):
                    return
                if e.kind == "agg" and not self._horizontal(e, rows):
                    if not any(e == a for a, _ in aggs):
                        aggs.append((e, self.fresh("agg")))
                    return
                if e.kind in ("exists", "value"):
                    return
                for x in e.args:
                    collect(x)
                if e.kind in ("case", "let_in"):
                    for pair in e.data:
                        for y in pair:
                            collect(y)

        for e in exprs:
            collect(e)
        calls = []
        for a, at in aggs:
            args = []
            for x in a.args:
                if has_aggregate(x):
                    raise GraphQueryError("aggregates can't be nested")
                rows, x, _ = self.lifted(rows, x)
                ids = self.expressions.identity(x, rows)
                if ids and a.data["name"] == "COUNT":
                    args.append(F.when(ids[1].isNotNull(), F.struct(*ids)))
                else:
                    args.append(self.expressions(x, rows))
            keep_if = None
            if a.data.get("filter") is not None:
                rows, cond, _ = self.lifted(rows, a.data["filter"])
                keep_if = F.coalesce(self.expressions(cond, rows), F.lit(False))
            by = [(self.expressions(e, rows), up, nulls) for e, up, nulls in a.data["order"].items] if a.data.get("order") else None
            if a.data["name"].startswith("PERCENTILE") and len(a.args) == 2:
                share = self.expressions.constant_of(a.args[1])
                if not 0 <= share <= 1:
                    raise GraphQueryError("a percentile's share lies between 0 and 1")
            calls.append((at, a, args, keep_if, by))
        # what is neither grouped nor aggregated comes, without GROUP BY, from any one row
        rest: dict[str, Column] = {}
        if group_by is None:
            for n, b in rows.env.items():
                if n not in env and not n.startswith(" "):
                    if any(isinstance(x, Expr) and x.kind == "var" and x.data == n for e in exprs for x in self._outside(e)):
                        for c in b.columns(rows.df):
                            rest[c] = col(c)
                        env[n] = b
        else:
            for e in exprs:
                for x in self._outside(e, swaps):
                    if isinstance(x, Expr) and x.kind == "var" and x.data in rows.env and x.data not in env:
                        raise GraphQueryError(f"{x.data} is neither grouped nor aggregated")
        df, calc = rows.df, []
        for at, a, args, k, by in calls:
            if a.data["name"] == "PERCENTILE_DISC" and not a.data["distinct"] and isinstance(kind := self.expressions.kind_of(args[0], rows), EXACT_IN_DOUBLE):
                # by counts of values; lists of whole groups only where a double can't hold a value
                x, share = self.fresh("disc"), self.expressions.constant_of(a.args[1])
                df = df.withColumn(x, args[0] if k is None else F.when(k, args[0]))
                calc.append(F.expr(f"percentile_disc({float(share)!r}D) WITHIN GROUP (ORDER BY `{x}`)").cast(kind).alias(at))
            else:
                calc.append(aggregate(a.data["name"], args, a.data["distinct"], k, by, None if self.times is None else col(self.times)).alias(at))
        calc += [F.first(c).alias(n) for n, c in {**carried, **rest}.items() if n not in keys]
        if not calc:
            calc = [F.count(F.lit(1)).alias(self.fresh("rows"))]
        out = df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(*calc) if keys else df.agg(*calc)
        swaps += [(a, Expr("column", [], at)) for a, at in aggs]

        def swap(e: Expr) -> Expr:
            return replaced(e, lambda y: next((new for old, new in swaps if y == old), None))

        return Rows(out, env), swap

    def _horizontal(self, e: Expr, rows: Rows) -> bool:
        x = e.args[0] if e.args else None
        return e.data["name"] == "SUM" and x.kind == "prop" and x.args[0].kind == "var" and x.args[0].data in rows.env and rows.env[x.args[0].data].kind in ("edges", "vertices")

    def _outside(self, e: Any, swaps: list | None = None):
        """Parts of an expression that are in no aggregate and no group key."""
        if isinstance(e, Expr):
            if any(e == k for k, _ in swaps or []):
                return
            yield e
            if e.kind == "agg":
                return
            for x in e.args:
                yield from self._outside(x, swaps)
            if e.kind in ("case", "let_in"):
                for pair in e.data:
                    for y in pair:
                        yield from self._outside(y, swaps)


def df_eq(name: str, a: DataFrame, b: DataFrame) -> Column:
    return a[name].eqNullSafe(b[name])


__all__ = ["Compiler"]
