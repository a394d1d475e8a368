"""Graph patterns as joins that extend the rows bound so far."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..gql import ast as A
from ..gql.ast import Expr
from ..graph import col
from ..operators.edges import arms, joined_arms, vertices
from .paths import Paths
from .scope import Binding, GraphQueryError, Rows, label_column, label_test


class Patterns(Paths):
    """Needs: graph, expressions (Expressions), used (variables whose properties the query reads), fresh()."""

    def needs(self, var: str | None) -> bool:
        return var is not None and ("*" in self.used or self.used.get(var, set()) is None or bool(self.used.get(var)))

    def reads_all(self, var: str) -> bool:
        return var in self.used or "*" in self.used

    def node_tables(self, label: Expr | None, among: set[str] | None = None) -> tuple[str, ...]:
        return tuple(t.name for t in self.graph.vertices if (t.dynamic or label_test(label, t.labels)) and (among is None or t.name in among))

    def _dynamic(self, tables: tuple[str, ...]) -> bool:
        return any(self.graph.vertices[self.graph.table_no(x)].dynamic for x in tables)

    def _must_load(self, name: str, node: A.Node, tables: tuple[str, ...]) -> bool:
        return bool(self.needs(name) or node.props or node.where is not None or not self.graph.complete or self._dynamic(tables) and (node.label is not None or "@labels" in (self.used.get(name) or ())))

    def conditions(self, rows: Rows, name: str, node: A.Node | A.Edge, dynamic_label: bool = False) -> Rows:
        """Rows that the element's own properties and condition leave."""
        conds: list[Expr] = [Expr("cmp", [Expr("prop", [Expr("var", [], name)], p), e], "=") for p, e in node.props]
        if node.where is not None:
            conds.append(node.where)
        for e in conds:
            rows = self.filtered(rows, e)
        if dynamic_label and node.label is not None:
            b = rows.env[name]
            rows = rows.at(rows.df.where(label_column(node.label, col(f"{b.at}@l"))))
        return rows

    def filtered(self, rows: Rows, e: Expr) -> Rows:
        """Rows for which the condition is true; subqueries in it are joined first."""
        rows, e, extra = self.lifted(rows, e)
        df = self.frame(rows).where(self.expressions(e, rows))
        return rows.at(df.drop(*extra) if extra else df)

    def frame(self, rows: Rows) -> DataFrame:
        return self.unit() if rows.df is None else rows.df

    def scan(self, rows: Rows, name: str, node: A.Node) -> Rows:
        """All vertices that the node allows, beside each row so far."""
        tables = self.node_tables(node.label)
        at = self.fresh(name)
        if tables:
            df = vertices(self.graph, tables, at)
        else:
            df = self.unit().select(F.lit(0).alias(f"{at}@t"), F.lit(0).cast("long").alias(f"{at}@k")).where(F.lit(False))
        b = Binding("vertex", at, tables, True, graph=self.graph)
        here = self.conditions(Rows(df, {**rows.env, name: b}), name, node, self._dynamic(tables)) if not self._reads_outer(node, name) else None
        if here is not None:
            df = here.df
        out = Rows(df if rows.df is None else rows.df.crossJoin(df), rows.env | {name: b})
        return out if here is not None else self.conditions(out, name, node, self._dynamic(tables))

    def _reads_outer(self, node: A.Node | A.Edge, name: str) -> bool:
        """Whether its conditions name other variables or hold subqueries."""
        for x in A.walk([node.props, node.where]):
            if isinstance(x, Expr) and (x.kind in ("exists", "value") or x.kind == "var" and x.data != name):
                return True
        return False

    def loaded(self, rows: Rows, name: str) -> Rows:
        """The vertex's properties joined on."""
        b = rows.env[name]
        if b.loaded or b.kind != "vertex" or not b.tables:
            return rows
        at = self.fresh("load")
        v = vertices(b.graph or self.graph, b.tables, at)
        cond = col(f"{b.at}@k") == col(f"{at}@k")
        if len(b.tables) > 1:
            cond = cond & (col(f"{b.at}@t") == col(f"{at}@t"))
        df = rows.df.join(v, cond).drop(f"{at}@t", f"{at}@k")
        df = df.withColumnsRenamed({c: b.at + c[len(at) :] for c in v.columns if c not in (f"{at}@t", f"{at}@k")})
        return rows.at(df).bound(name, replace(b, loaded=True))

    def bound_node(self, rows: Rows, name: str, node: A.Node) -> Rows:
        """A node pattern over a variable that is bound already."""
        b = rows.env[name]
        if b.kind != "vertex":
            raise GraphQueryError(f"{name} is no vertex")
        rows = rows.at(rows.df.where(col(f"{b.at}@k").isNotNull()))
        if not b.loaded and self._must_load(name, node, b.tables):
            rows = self.loaded(rows, name)
            b = rows.env[name]
        if node.label is not None:
            keep = tuple(x for x in b.tables if (t := self.graph.vertices[self.graph.table_no(x)]).dynamic or label_test(node.label, t.labels))
            if keep != b.tables:
                nos = [self.graph.table_no(x) for x in keep]
                rows = rows.at(rows.df.where(col(f"{b.at}@t").isin(*nos) if nos else F.lit(False))).bound(name, replace(b, tables=keep))
        return self.conditions(rows, name, node, self._dynamic(rows.env[name].tables) and node.label is not None)

    def hop(self, rows: Rows, near: str | None, edge: A.Edge, edge_name: str, far: str, far_node: A.Node, near_node: A.Node | None = None, near_name: str | None = None) -> Rows:
        """One edge from near (bound; None: the edges start the rows) to far."""
        g = self.graph
        nb = rows.env[near] if near else None
        near_tables = set(nb.tables) if nb else set(self.node_tables(near_node.label if near_node else None))
        bound = rows.env.get(far)
        far_tables = set(self.node_tables(far_node.label, set(bound.tables) if bound and bound.kind == "vertex" else None))
        found = arms(g, edge.direction, edge.label, near_tables, far_tables)
        at = self.fresh(edge_name)
        if not found:
            base = self.frame(rows).where(F.lit(False))
            cols = {f"{at}@t": F.lit(0), f"{at}@id": F.lit(0).cast("long"), f"{at}@st": F.lit(0), f"{at}@s": F.lit(0).cast("long"), f"{at}@dt": F.lit(0), f"{at}@d": F.lit(0).cast("long")}
            new = {edge_name: Binding("edge", at, (), graph=g)}
            if near is None:
                cols |= {f"{at}n@t": F.lit(0), f"{at}n@k": F.lit(0).cast("long")}
                new[near_name] = Binding("vertex", f"{at}n", (), graph=g)
            if bound is None:
                cols |= {f"{at}f@t": F.lit(0), f"{at}f@k": F.lit(0).cast("long")}
                new[far] = Binding("vertex", f"{at}f", (), graph=g)
            return Rows(base.withColumns(cols), rows.env | new)
        e = joined_arms(found)
        props = [c for c in e.columns if c.startswith("p@")]
        e = e.select(*(col(c).alias(f"{at}@{c}") for c in ("t", "id", "st", "s", "dt", "d", *props)), col("nt").alias(f"{at}n@t"), col("nk").alias(f"{at}n@k"), col("ft").alias(f"{at}f@t"), col("fk").alias(f"{at}f@k"))
        eb = Binding("edge", at, tuple(dict.fromkeys(a.table for a in found)), graph=g)
        narrow = not self._reads_outer(edge, edge_name)
        if narrow:
            e = self.conditions(Rows(e, {edge_name: eb}), edge_name, edge).df
        far_found = tuple(dict.fromkeys(x for a in found for x in a.far))
        near_found = tuple(dict.fromkeys(x for a in found for x in a.near))
        env = dict(rows.env) | {edge_name: eb}
        if near is None:
            df = e if rows.df is None else rows.df.crossJoin(e)
            env[near_name] = Binding("vertex", f"{at}n", near_found, False, graph=g)
        else:
            cond = col(f"{nb.at}@k") == col(f"{at}n@k")
            if len(nb.tables) > 1 or len(near_found) > 1:
                cond = cond & (col(f"{nb.at}@t") == col(f"{at}n@t"))
            if bound is not None and far != near:
                cond = cond & (col(f"{bound.at}@k") == col(f"{at}f@k"))
                if len(bound.tables) > 1 or len(far_found) > 1:
                    cond = cond & (col(f"{bound.at}@t") == col(f"{at}f@t"))
            df = rows.df.join(e, cond)
            if far == near:
                df = df.where((col(f"{at}n@k") == col(f"{at}f@k")) & (col(f"{at}n@t") == col(f"{at}f@t")))
            df = df.drop(f"{at}n@t", f"{at}n@k")
        if near is None and far == near_name:
            df = df.where((col(f"{at}n@k") == col(f"{at}f@k")) & (col(f"{at}n@t") == col(f"{at}f@t"))).drop(f"{at}f@t", f"{at}f@k")
        elif near is None and bound is not None:
            raise GraphQueryError("internal: a path starts at its bound end")
        elif bound is not None:
            df = df.drop(f"{at}f@t", f"{at}f@k")
        else:
            env[far] = Binding("vertex", f"{at}f", far_found, False, graph=g)
        rows = Rows(df, env)
        if not narrow:
            rows = self.conditions(rows, edge_name, edge)
        if near is None and near_node is not None:
            rows = self.arrived(rows, near_name, near_node)
        return self.arrived(rows, far, far_node) if not (near is None and far == near_name) else rows

    def arrived(self, rows: Rows, name: str, node: A.Node) -> Rows:
        """What a node pattern asks of a vertex that a hop has reached."""
        b = rows.env[name]
        if not b.loaded and self._must_load(name, node, b.tables):
            rows = self.loaded(rows, name)
        if b.loaded and node.label is not None:
            return self.bound_node(rows, name, node)
        return self.conditions(rows, name, node, self._dynamic(b.tables) and node.label is not None)

    # paths
    def normalized(self, parts: list[Any]) -> list[Any]:
        """Nodes and edges in turn, with nameless nodes put in; groups that aren't repeated are opened up."""
        out: list[Any] = []
        for x in parts:
            if isinstance(x, A.Group) and x.quantifier is None:
                inner = self.normalized(x.path.parts)
                if x.where is not None:
                    inner[-1] = replace(inner[-1], where=x.where if inner[-1].where is None else Expr("and", [inner[-1].where, x.where]))
                if out and isinstance(out[-1], A.Node) and isinstance(inner[0], A.Node):
                    out[-1:] = [self.merged(out[-1], inner[0])]
                    inner = inner[1:]
                out += inner
                continue
            if isinstance(x, A.Edge) and x.quantifier is not None:
                x = A.Group(A.Path([replace(x, quantifier=None)]), None, x.quantifier)
            if isinstance(x, A.Node):
                if out and isinstance(out[-1], A.Node):
                    out[-1] = self.merged(out[-1], x)
                else:
                    out.append(x)
                continue
            if not out or not isinstance(out[-1], A.Node):
                out.append(A.Node())
            out.append(x)
        if not out or not isinstance(out[-1], A.Node):
            out.append(A.Node())
        return [replace(x, var=x.var or f" n{self.number()}") if isinstance(x, (A.Node, A.Edge)) else x for x in out]

    def merged(self, a: A.Node, b: A.Node) -> A.Node:
        """Two node patterns that meet at one vertex."""
        both = lambda x, y: x if y is None else y if x is None else Expr("and", [x, y])
        if a.var and b.var and a.var != b.var and not b.var.startswith(" ") and not a.var.startswith(" "):
            same = Expr("cmp", [Expr("var", [], a.var), Expr("var", [], b.var)], "=")
            raise GraphQueryError(f"{a.var} and {b.var} name one vertex; compare them with {same.data} instead")
        var = b.var if b.var and (not a.var or a.var.startswith(" ")) else a.var
        return A.Node(var, both(a.label, b.label), [*a.props, *b.props], both(a.where, b.where))

    def path(self, rows: Rows, p: A.Path) -> Rows:
        for k, x in enumerate(p.parts):
            if isinstance(x, A.Alternation):
                return self.alternatives(rows, p, k, x)
        if p.search and p.search[0] in ("ANY SHORTEST", "ALL SHORTEST", "SHORTEST", "SHORTEST GROUP"):
            return self.shortest(rows, p)
        parts = self.normalized(p.parts)
        if p.cost is not None:
            raise GraphQueryError("COST BY goes with a shortest path")
        names = [x.var for x in parts if isinstance(x, A.Node)]
        start = next((i for i, n in enumerate(names) if n in rows.env), None)
        ends_before = set(rows.env)
        pieces: dict[int, str] = {}  # of a repeated part, the prefix of its columns
        if start is None:
            hop = parts[1] if len(parts) > 1 else None
            first = parts[0]
            from_edges = isinstance(hop, A.Edge) and self.graph.complete and not self._must_load(first.var, first, self.node_tables(first.label)) and parts[2].var != first.var
            if from_edges:
                rows = self.hop(rows, None, hop, hop.var, parts[2].var, parts[2], first, first.var)
                done, start = {1}, 0
            else:
                rows, done, start = self.scan(rows, first.var, first), set(), 0
        else:
            rows, done = self.bound_node(rows, names[start], parts[2 * start]), set()
        for k in range(2 * start + 1, len(parts), 2):
            if k not in done:
                rows = self.step(rows, parts[k - 1], parts[k], parts[k + 1], False, p.mode, pieces, k)
        for k in range(2 * start - 1, 0, -2):
            rows = self.step(rows, parts[k + 1], parts[k], parts[k - 1], True, p.mode, pieces, k)
        rows = self.path_rules(rows, p, parts, pieces, ends_before)
        return rows

    def step(self, rows: Rows, near: A.Node, link: Any, far: A.Node, back: bool, mode: str | None, pieces: dict[int, str], k: int) -> Rows:
        if isinstance(link, A.Edge):
            e = replace(link, direction=_BACK[link.direction]) if back else link
            return self.hop(rows, near.var, e, e.var, far.var, far)
        rows, pieces[k] = self.repeated(rows, near.var, link, far, back, link.mode or mode)
        return rows

    def path_rules(self, rows: Rows, p: A.Path, parts: list[Any], pieces: dict[int, str], before: set[str]) -> Rows:
        """The path variable, an explicit path mode over the whole path, ANY k, and COUNT PATHS."""
        counted = p.search is not None and p.search[0] == "COUNT PATHS"
        name = None if counted else p.var
        wanted = name is not None and self.reads_all(name)
        plain = p.mode in (None, "WALK")
        if wanted or not plain:
            vs, es = [], []
            for k, x in enumerate(parts):
                if isinstance(x, A.Node):
                    b = rows.env[x.var]
                    if not (k and k - 1 in pieces and isinstance(parts[k - 1], A.Group)):
                        vs.append(F.array(_point(col(f"{b.at}@t"), col(f"{b.at}@k"))))
                elif isinstance(x, A.Edge):
                    b = rows.env[x.var]
                    es.append(F.array(F.struct(col(f"{b.at}@t").cast("int").alias("t"), col(f"{b.at}@id").alias("id"))))
                else:
                    vs.append(F.slice(col(f"{pieces[k]}@v"), 2, F.greatest(F.size(col(f"{pieces[k]}@v")) - 1, F.lit(0))))
                    es.append(col(f"{pieces[k]}@e"))
            at = self.fresh(name or "path")
            none = F.array().cast("array<struct<t:int,id:bigint>>")
            df = rows.df.withColumns({f"{at}@v": F.concat(*vs), f"{at}@e": F.concat(*es) if es else none})
            if p.mode in ("SIMPLE", "ACYCLIC"):
                v = col(f"{at}@v")
                ok = F.size(F.array_distinct(v)) == F.size(v)
                if p.mode == "SIMPLE":
                    rest = F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
                    ok = ok | (F.get(v, F.lit(0)) == F.get(v, F.size(v) - 1)) & (F.size(F.array_distinct(rest)) == F.size(rest)) & (F.size(v) > 1)
                df = df.where(ok)
            elif p.mode == "TRAIL":
                df = df.where(F.size(F.array_distinct(col(f"{at}@e"))) == F.size(col(f"{at}@e")))
            rows = rows.at(df)
            if name is not None:
                rows = rows.bound(name, Binding("path", at, graph=self.graph))
        if p.search and p.search[0] == "ANY":
            rows = self.any_k(rows, parts, p.search[1] or 1, before)
        return self.counted(rows, p.var, parts, before) if counted else rows

    def counted(self, rows: Rows, name: str | None, parts: list[Any], before: set[str]) -> Rows:
        """One row for each pair of ends, beside each row before; the path's variable is the number of paths between them."""
        env = {n: b for n, b in rows.env.items() if n in before or n in (parts[0].var, parts[-1].var)}
        keep = dict.fromkeys(c for b in env.values() for c in b.columns(rows.df))
        at = self.fresh(name or "paths")
        df = rows.df.groupBy(*map(col, keep)).agg(F.count(F.lit(1)).alias(at))
        return Rows(df, env | ({name: Binding("value", at)} if name is not None else {}))

    def alternatives(self, rows: Rows, p: A.Path, k: int, x: A.Alternation) -> Rows:
        """Each branch in the place of the alternation, joined by column name."""
        outs = []
        for b in x.branches:
            got = (self.path(rows, replace(p, parts=[*p.parts[:k], *([A.Group(b)] if len(p.parts) > 1 else b.parts), *p.parts[k + 1 :]], mode=p.mode or b.mode, search=p.search or b.search)))
            if x.distinct:  # paths are the same if their edges are, named or not
                links = [F.array(F.struct(col(f"{e.at}@t").cast("int").alias("t"), col(f"{e.at}@id").alias("id"))) for n, e in got.env.items() if n not in rows.env and e.kind == "edge"]
                links += [col(c) for c in got.df.columns if c.endswith("@e") and (rows.df is None or c not in rows.df.columns)]
                got = got.at(got.df.withColumn("_links", F.concat(*links) if links else F.array().cast("array<struct<t:int,id:bigint>>")))
            outs.append(got)
        return self.unioned(outs, x.distinct)

    def unioned(self, outs: list[Rows], distinct: bool) -> Rows:
        """Branches' rows over the variables that any of them binds."""
        names = list(dict.fromkeys(n for r in outs for n in r.env if not n.startswith(" ")))
        env: dict[str, Binding] = {}
        frames: list[DataFrame] = [r.df for r in outs]
        for n in names:
            found = [r.env.get(n) for r in outs]
            have = [b for b in found if b is not None]
            if len({b.kind for b in have}) > 1:
                raise GraphQueryError(f"{n} is of different kinds in the branches")
            first, at = have[0], self.fresh(n)
            if all(b is not None and b.at == first.at for b in found):
                at = first.at
            else:
                for i, b in enumerate(found):
                    if b is not None:
                        cols = b.columns(frames[i])
                        frames[i] = frames[i].withColumnsRenamed({c: at + c[len(b.at) :] for c in cols})
            tables = tuple(dict.fromkeys(t for b in have for t in b.tables))
            env[n] = replace(first, at=at, tables=tables, loaded=all(b.loaded for b in have))
        keep = [[c for c in f.columns if c == "_links" or any(c == b.at or c.startswith(b.at + "@") for b in env.values())] for f in frames]
        out = frames[0].select(*map(col, keep[0]))
        for f, cols in zip(frames[1:], keep[1:], strict=True):
            out = out.unionByName(f.select(*map(col, cols)), allowMissingColumns=True)
        return Rows(out.distinct().drop("_links") if distinct else out, env)

    def _free_order(self, paths: list[A.Path], before: set[str]) -> bool:
        """Whether paths can be joined in any order: plain ones, none of whose conditions names what another binds."""
        for p in paths:
            if p.search or p.cost is not None or any(not isinstance(x, (A.Node, A.Edge)) or isinstance(x, A.Edge) and x.quantifier for x in p.parts):
                return False
            own = before | {x.var for x in p.parts if x.var}
            if any(isinstance(x, Expr) and (x.kind in ("exists", "value") or x.kind == "var" and x.data not in own) for x in A.walk(p.parts)):
                return False
        return True

    def match(self, rows: Rows, pattern: A.Pattern) -> Rows:
        """The rows extended by everything the pattern matches."""
        before = set(rows.env)
        todo = list(pattern.paths)
        if pattern.keep:
            todo = [replace(p, mode=p.mode or pattern.keep[0], search=p.search or pattern.keep[1]) for p in todo]
        if pattern.match_mode == "REPEATABLE":
            # elements may repeat within a path too, unless it says otherwise
            todo = [replace(p, mode=p.mode or "WALK") if p.search is None or p.search[0] in ("ANY", "ALL", "COUNT PATHS") else p for p in todo]
        if self._free_order(todo, before):
            todo.sort(key=_turns)
        while todo:
            # a path that touches what is bound comes before one that would be a product
            p = next((p for p in todo if any(isinstance(x, A.Node) and x.var in rows.env for x in A.walk(p.parts))), todo[0])
            todo.remove(p)
            rows = self.path(rows, p)
        if pattern.match_mode == "DIFFERENT":
            new = [b for n, b in rows.env.items() if n not in before and b.kind == "edge"]
            for i, a in enumerate(new):
                for b in new[:i]:
                    rows = rows.at(rows.df.where(~((col(f"{a.at}@t") == col(f"{b.at}@t")) & (col(f"{a.at}@id") == col(f"{b.at}@id")))))
        if pattern.where is not None:
            rows = self.filtered(rows, pattern.where)
        if pattern.insertion:
            b = rows.env[pattern.insertion]
            rows = rows.at(rows.df.orderBy(col(f"{b.at}@t"), col(f"{b.at}@id")))
        return Rows(rows.df, {n: b for n, b in rows.env.items() if not n.startswith(" ")})


def _turns(p: A.Path) -> int:
    """How often a path meets itself: two edges into one node, or out of it, pair all of the one side with all of the other."""
    edges = [x for x in p.parts if isinstance(x, A.Edge)]
    return sum({a.direction, b.direction} == {"left", "right"} for a, b in zip(edges, edges[1:], strict=False))


def _point(t: Column, k: Column) -> Column:
    return F.struct(t.cast("int").alias("t"), k.alias("k"))


_BACK = {"right": "left", "left": "right", "left_right": "left_right", "undirected": "undirected", "left_undirected": "undirected_right", "undirected_right": "left_undirected", "any": "any"}

