"""Syntax trees.  Expressions share one node type whose kind says what it is; clauses have their own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Expr:
    kind: str
    args: list[Any] = field(default_factory=list)
    data: Any = None


@dataclass
class Node:
    var: str | None = None
    label: Expr | None = None
    props: list[tuple[str, Expr]] = field(default_factory=list)
    where: Expr | None = None


@dataclass
class Edge:
    direction: str  # of: right left undirected left_right left_undirected undirected_right any
    var: str | None = None
    label: Expr | None = None
    props: list[tuple[str, Expr]] = field(default_factory=list)
    where: Expr | None = None
    quantifier: tuple[int, int | None] | None = None


@dataclass
class Group:
    """A parenthesized part of a path, with its own condition and quantifier."""

    path: Any
    where: Expr | None = None
    quantifier: tuple[int, int | None] | None = None
    mode: str | None = None


@dataclass
class Alternation:
    branches: list[Any]
    distinct: bool  # | joins branches as a set union, |+| as a multiset


@dataclass
class Path:
    parts: list[Any]  # Node and Edge in turn; Group or Alternation may stand for a part
    var: str | None = None
    mode: str | None = None  # WALK TRAIL SIMPLE ACYCLIC
    search: tuple[str, int | None] | None = None  # ('ANY', k) ('ALL', None) ('ANY SHORTEST', None) ...
    cost: Expr | None = None


@dataclass
class Pattern:
    paths: list[Path]
    where: Expr | None = None
    match_mode: str | None = None
    keep: tuple | None = None
    insertion: str | None = None


@dataclass
class Match:
    pattern: Pattern
    optional: bool = False
    block: list[Any] | None = None  # OPTIONAL { MATCH ... MATCH ... }


@dataclass
class Filter:
    cond: Expr


@dataclass
class Let:
    items: list[tuple[str, Expr]]


@dataclass
class For:
    var: str
    source: Expr
    counter: str | None = None
    one_based: bool = True


@dataclass
class OrderBy:
    items: list[tuple[Expr, bool, bool | None]]  # expression, ascending, nulls first (None: default)


@dataclass
class Page:
    offset: Expr | None
    limit: Expr | None


@dataclass
class Call:
    query: Any
    scope: list[str] | None
    optional: bool = False


@dataclass
class CallProcedure:
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]] | None
    optional: bool = False


@dataclass
class Search:
    var: str
    index: str
    query: Expr
    where: Expr | None
    limit: Expr
    output: str  # SCORE or DISTANCE
    alias: str


@dataclass
class Use:
    graph: str


@dataclass
class Return:
    items: list[tuple[Expr, str | None]] | None  # None: *
    distinct: bool = False
    group_by: list[Expr] | None = None
    having: Expr | None = None
    order: OrderBy | None = None
    page: Page | None = None
    no_bindings: bool = False
    source: Any = None  # SELECT ... FROM
    where: Expr | None = None


@dataclass
class Finish:
    pass


@dataclass
class Linear:
    clauses: list[Any]


@dataclass
class Composite:
    first: Linear
    rest: list[tuple[str, bool, Linear]]  # operator, all, query


@dataclass
class Block:
    """Statements joined by NEXT; each but the first may have YIELD items."""

    statements: list[Any]
    yields: list[list[tuple[str, str]] | None]
    bindings: list[tuple[str, Any]] = field(default_factory=list)


@dataclass
class Insert:
    paths: list[Path]


@dataclass
class SetItems:
    items: list[tuple]  # ('prop', v, p, e) ('all', v, e) ('label', v, l)


@dataclass
class Remove:
    items: list[tuple]  # ('prop', v, p) ('label', v, l)


@dataclass
class Delete:
    detach: bool
    vars: list[Expr]


@dataclass
class Catalog:
    """A DDL or session statement: what it does and its operands."""

    action: str
    name: str | None = None
    data: dict = field(default_factory=dict)


def walk(x: Any) -> Iterator[Any]:
    """All nodes below x, itself included."""
    if is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, (list, tuple)):
        for y in x:
            yield from walk(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from walk(y)
