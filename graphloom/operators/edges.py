"""Edges as seen from one end: near and far, for each of the seven directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..gql.ast import Expr
from ..graph import EdgeTable, Graph, col
from ..plans.scope import label_test

_PARTS = {"right": ("out",), "left": ("in",), "left_right": ("in", "out"), "undirected": ("both",), "left_undirected": ("in", "both"), "undirected_right": ("both", "out"), "any": ("in", "both", "out")}


@dataclass
class Arm:
    """df: nt nk ft fk (near and far table and key), t id st s dt d, p@name."""

    df: DataFrame
    near: tuple[str, ...]
    far: tuple[str, ...]
    table: str


def _ends(g: Graph, t: EdgeTable) -> DataFrame:
    no = lambda name, c: (F.lit(g.table_no(name)) if name else col(c)).cast("int")
    props = [col(c) for c in t.df.columns if c.startswith("p@")]
    return t.df.select(F.lit(g.edge_no(t.name)).alias("t"), col("e").alias("id"), no(t.src, "st").alias("st"), col("s"), no(t.dst, "dt").alias("dt"), col("d"), *props)


def arms(g: Graph, direction: str, label: Expr | None, near: set[str], far: set[str], where=None) -> list[Arm]:
    """The edge tables and orientations that lead from near to far tables; where filters edges before joining."""
    every = tuple(t.name for t in g.vertices)
    out: list[Arm] = []
    for t in g.edges:
        if not label_test(label, frozenset([t.label] if t.label else [])):
            continue
        for part in _PARTS[direction]:
            if (part == "both") == t.directed:
                continue
            ways = [False] if part == "out" else [True] if part == "in" else [False, True]
            for back in ways:
                a, b = ((t.src,) if t.src else every), ((t.dst,) if t.dst else every)
                if back:
                    a, b = b, a
                a, b = tuple(x for x in a if x in near), tuple(x for x in b if x in far)
                if not a or not b:
                    continue
                df = _ends(g, t)
                if part == "both" and back:  # an undirected loop is one edge, met once
                    df = df.where(~((col("st") == col("dt")) & (col("s") == col("d"))))
                x, y = (("dt", "d"), ("st", "s")) if back else (("st", "s"), ("dt", "d"))
                df = df.withColumns({"nt": col(x[0]), "nk": col(x[1]), "ft": col(y[0]), "fk": col(y[1])})
                if (t.dst if back else t.src) is None:
                    df = df.where(col("nt").isin(*(g.table_no(z) for z in a)))
                if (t.src if back else t.dst) is None:
                    df = df.where(col("ft").isin(*(g.table_no(z) for z in b)))
                out.append(Arm(df, a, b, t.name))
    return out


def joined_arms(found: list[Arm]) -> DataFrame:
    df = found[0].df
    for a in found[1:]:
        df = df.unionByName(a.df, allowMissingColumns=True)
    return df


def vertices(g: Graph, tables: tuple[str, ...], at: str) -> DataFrame:
    """The vertices of some tables: at@t, at@k, at@p@name, at@l where labels differ by row."""
    df = None
    dynamic = any(g.vertices[g.table_no(x)].dynamic for x in tables)
    for x in tables:
        t = g.vertices[g.table_no(x)]
        cols: list[Column] = [F.lit(g.table_no(x)).cast("int").alias(f"{at}@t"), col("k").alias(f"{at}@k"), *(col(c).alias(f"{at}@{c}") for c in t.df.columns if c.startswith("p@"))]
        if dynamic:
            cols.append((col("ls") if t.dynamic else F.array(*map(F.lit, sorted(t.labels))).cast("array<string>")).alias(f"{at}@l"))
        one = t.df.select(*cols)
        df = one if df is None else df.unionByName(one, allowMissingColumns=True)
    return df
