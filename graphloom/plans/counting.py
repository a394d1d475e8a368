"""Queries that only count what they match: rows that later steps can't tell apart become one row with a number.

Two edges into one node, or out of it, pair all of the one side with all of the other.  Where the result needs
no more of the pairs than how many they are, the first side is counted for each node before the second is
joined; and what an OPTIONAL MATCH finds is counted for each of its starts before it is joined back.  If its
condition compares a property of what it finds with one of an outer vertex, those counts are running sums in
the order of the property, so that no pair is made at all.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..gql import ast as A
from ..gql.ast import Expr
from ..graph import col
from .scope import Binding, Rows, pattern_vars, uses

_SWAPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _exprs(x: Any) -> list[Expr]:
    return [e for e in A.walk(x) if isinstance(e, Expr)]


def _sides(matches: list[A.Match], at: str, kept: list[str]) -> set[str]:
    """Whether edges go out of a variable or into it, of edges neither of which nor whose other end is kept."""
    out: set[str] = set()
    for m in matches:
        for p in m.pattern.paths:
            for a, e, b in zip(p.parts, p.parts[1:], p.parts[2:], strict=False):
                if isinstance(e, A.Edge) and e.var not in kept:
                    ways = {"right": ("out", "in"), "left": ("in", "out")}.get(e.direction)
                    for x, y, i in ((a, b, 0), (b, a, 1)):
                        if x.var == at and y.var not in kept:
                            out |= {ways[i]} if ways else {"in", "out"}
    return out


def _only_counted(x: Any, names: set[str]) -> bool:
    """Whether the variables are named in COUNT(variable) at most."""
    if isinstance(x, Expr):
        if x.kind == "var":
            return x.data not in names
        if x.kind == "agg" and x.data["name"] == "COUNT" and not x.data["distinct"] and x.args[0].kind == "var":
            return _only_counted(x.data, names)
        return _only_counted(x.args, names) and _only_counted(x.data, names)
    if isinstance(x, dict):
        return all(_only_counted(y, names) for y in x.values())
    if isinstance(x, (list, tuple)):
        return all(_only_counted(y, names) for y in x)
    return not hasattr(x, "__dataclass_fields__") or all(_only_counted(getattr(x, f), names) for f in x.__dataclass_fields__)


class Counting:
    """counts: whether the query at hand only counts; times: the column with the number of rows that a row stands for."""

    counts = False
    times: str | None = None

    def only_counts(self, clauses: list[Any], rows: Rows, keep: list[str]) -> bool:
        """MATCHes of plain paths and a RETURN whose aggregates count, or take no notice of repeated rows."""
        *matches, r = clauses or [None]
        if rows.df is not None or keep or not matches or not isinstance(r, A.Return) or r.items is None or r.source is not None or r.distinct or r.no_bindings:
            return False
        for m in matches:
            if not isinstance(m, A.Match) or m.block is not None or m.pattern.keep or m.pattern.insertion or m.pattern.match_mode:
                return False
            for p in m.pattern.paths:
                if p.search or p.cost is not None or p.var or p.mode or any(not isinstance(x, (A.Node, A.Edge)) or isinstance(x, A.Edge) and x.quantifier for x in p.parts):
                    return False
        aggs = [e for e in _exprs(r) if e.kind == "agg"]
        fits = all(e.data["name"] in ("COUNT(*)", "COUNT", "MIN", "MAX") for e in aggs)
        return bool(aggs) and fits and not any(e.kind in ("exists", "value") for e in _exprs(clauses))

    def pieces(self, clauses: list[Any]) -> list[Any]:
        """The clauses with each MATCH cut where its paths meet, each piece with the conditions on what is bound by then."""
        out: list[Any] = []
        bound: set[str] = set()
        for m in clauses:
            if isinstance(m, A.Match) and not m.optional and self._free_order(m.pattern.paths, bound):
                paths = sorted((replace(p, parts=self._named(p.parts)) for p in m.pattern.paths), key=_turned)
                todo = [x for p in paths for x in _cut(p)]
                if len(todo) > 1:
                    conds = _conjuncts(m.pattern.where)
                    while todo:
                        p = next((p for p in todo if pattern_vars(p) & bound), todo[0])
                        todo.remove(p)
                        bound |= pattern_vars(p)
                        mine = [e for e in conds if not todo or {x.data for x in _exprs(e) if x.kind == "var"} <= bound]
                        conds = [e for e in conds if e not in mine]
                        where = None
                        for e in mine:
                            where = e if where is None else Expr("and", [where, e])
                        out.append(A.Match(A.Pattern([p], where)))
                    continue
            if isinstance(m, A.Match):
                bound |= pattern_vars(m)
            out.append(m)
        return out

    def _named(self, parts: list[Any]) -> list[Any]:
        """Nodes between edges get names that outlast their MATCH."""
        parts = self.normalized(parts)
        return [replace(x, var=f"#{self.number()}") if isinstance(x, A.Node) and x.var.startswith(" ") and 0 < k < len(parts) - 1 else x for k, x in enumerate(parts)]

    def folded(self, rows: Rows, done: list[A.Match], later: list[Any]) -> Rows:
        """One row, with a number, for rows that are the same to all later clauses, if a later MATCH would pair them all with its own."""
        matches = [m for m in later if isinstance(m, A.Match)]
        if not matches or rows.df is None:
            return rows
        named, shown = uses(later), pattern_vars(later)
        kept = [n for n in rows.env if n in named or n in shown]
        met = [n for n in kept if n in pattern_vars(matches)]
        if len(met) != 1 or not _sides([self._whole(m) for m in done], met[0], kept) & _sides([self._whole(m) for m in matches], met[0], []):
            return rows
        cols: list[str] = []
        for n in kept:
            b, props = rows.env[n], named.get(n, set())
            if props is None or b.kind not in ("vertex", "edge"):
                return rows
            cols += [c for c in b.columns(rows.df) if not c.startswith(f"{b.at}@p@") or c[len(b.at) + 3 :] in props]
        if any("map<" in kind or "variant" in kind for c, kind in rows.df.dtypes if c in cols):
            return rows
        at = self.fresh("times")
        n = F.count(F.lit(1)) if self.times is None else F.sum(col(self.times))
        self.times = at
        return Rows(rows.df.groupBy(*map(col, dict.fromkeys(cols))).agg(n.alias(at)), {n: rows.env[n] for n in kept})

    def _whole(self, m: A.Match) -> A.Match:
        return replace(m, pattern=replace(m.pattern, paths=[replace(p, parts=self.normalized(p.parts)) for p in m.pattern.paths]))

    def counted_optional(self, c: A.Match, rows: Rows, r: A.Return) -> Rows | None:
        """The rows beside the number of their matches; None where r asks more of the matches than that."""
        new = {x.var: "vertex" if isinstance(x, A.Node) else "edge" for x in A.walk(c.pattern) if isinstance(x, (A.Node, A.Edge)) and x.var and x.var not in rows.env}
        if rows.df is None or not _only_counted(r, set(new)):
            return None
        found = self._by_order(c, rows, new) or self._by_start(c, rows)
        if found is None:
            return None
        sub, names, m = found
        df = self.joined_back(rows, sub, names, "left")
        times = self.fresh("times")
        n = F.coalesce(col(m), F.lit(1).cast("long"))
        df = df.withColumn(times, n if self.times is None else n * col(self.times))
        self.times = times
        env = {v: Binding(kind, self.fresh(v), (), True, graph=self.graph) for v, kind in new.items()}
        ids = {}
        for b in env.values():  # who matched isn't asked, but whether anything did is
            t, k = b.identity()
            ids |= {t: F.lit(0), k: F.when(col(m).isNotNull(), F.lit(0).cast("long"))}
        return Rows(df.withColumns(ids).drop(m), rows.env | env)

    def _by_start(self, c: A.Match, rows: Rows) -> tuple[DataFrame, dict[str, str], str] | None:
        start, keep, names = self.seeds(rows, [replace(c, optional=False)])
        if not keep:
            return None
        m = self.fresh("matches")
        out = self.match(start, c.pattern)
        return out.df.groupBy(*map(col, keep)).agg(F.count(F.lit(1)).alias(m)), names, m

    def _by_order(self, c: A.Match, rows: Rows, new: dict[str, str]) -> tuple[DataFrame, dict[str, str], str] | None:
        """Where the condition is an inequality between a found and an outer property: counts of the values before each.

        A window holds the different values that one start's matches, and its outer vertices, have.
        """
        w = c.pattern.where
        if w is None or w.kind != "cmp" or w.data not in _SWAPPED or any(x.kind != "prop" or x.args[0].kind != "var" for x in w.args):
            return None
        inner, outer, op = (*w.args, w.data) if w.args[0].args[0].data in new else (*reversed(w.args), _SWAPPED[w.data])
        bare = replace(c, optional=False, pattern=replace(c.pattern, where=None))
        of = outer.args[0].data
        if inner.args[0].data not in new or of not in rows.env or rows.env[of].kind not in ("vertex", "edge") or of in uses(bare) or of in pattern_vars(bare):
            return None
        value = f"{rows.env[of].at}@p@{outer.data}"
        start, keep, names = self.seeds(rows, [bare])
        if not keep or value not in rows.df.columns:
            return None
        v, n, p, m = (self.fresh(x) for x in ("value", "n", "asked", "matches"))
        found = self.match(start, bare.pattern)
        found = found.df.select(*map(col, keep), self.expressions(inner, found).alias(v))
        asked = rows.df.select(*(col(a).alias(b) for a, b in names.items()), col(value).alias(v))
        if found.schema[v].dataType != asked.schema[v].dataType:
            return None
        # equal values first become one row with their number
        both = found.select("*", F.lit(1).alias(n), F.lit(0).alias(p)).unionByName(asked.select("*", F.lit(0).alias(n), F.lit(1).alias(p))).where(col(v).isNotNull())
        both = both.groupBy(*map(col, keep), col(v)).agg(F.sum(n).alias(n), F.max(p).alias(p))
        order = col(v).desc() if op in (">", ">=") else col(v).asc()
        so_far = F.sum(col(n)).over(Window.partitionBy(*map(col, keep)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sub = both.withColumn(m, so_far if op in (">=", "<=") else so_far - col(n)).where((col(p) == 1) & (col(m) > 0)).drop(n, p)
        return sub, {**names, value: v}, m


def _turned(p: A.Path) -> int:
    return len(_cut(p))


def _cut(p: A.Path) -> list[A.Path]:
    """A path as pieces that end where it meets itself; their common node's own conditions stay with the first."""
    out, parts = [], list(p.parts)
    at = 0
    for k in range(2, len(parts) - 1, 2):
        if {parts[k - 1].direction, parts[k + 1].direction} == {"left", "right"}:
            out.append(replace(p, parts=parts[at : k + 1]))
            parts[k] = A.Node(parts[k].var)
            at = k
    return [*out, replace(p, parts=parts[at:])]


def _conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return [x for a in e.args for x in _conjuncts(a)] if e.kind == "and" else [e]
