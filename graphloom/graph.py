"""Property graphs over DataFrames, and the catalog that names them.

A vertex table holds the vertices of one set of labels, or, with a labels column, of any; an edge table the
edges of one label or of none.  A vertex is known by its table and key, so keys only need be unique within
a table.  Graphs are immutable: changing statements make new ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


@dataclass(frozen=True)
class VertexTable:
    """df: k (key), p@name for each property, and ls (array of labels) if they differ by row."""

    name: str
    labels: frozenset[str]
    df: DataFrame = field(compare=False)
    dynamic: bool = False

    @property
    def props(self) -> dict[str, DataType]:
        return {f.name[2:]: f.dataType for f in self.df.schema if f.name.startswith("p@")}


@dataclass(frozen=True)
class EdgeTable:
    """df: e (edge id), s and d (keys), p@name for each property; st and dt (tables) where src or dst is None."""

    name: str
    label: str | None
    df: DataFrame = field(compare=False)
    src: str | None = None
    dst: str | None = None
    directed: bool = True

    @property
    def props(self) -> dict[str, DataType]:
        return {f.name[2:]: f.dataType for f in self.df.schema if f.name.startswith("p@")}


@dataclass(frozen=True)
class VectorIndex:
    name: str
    label: str
    prop: str
    metric: str  # l2 or cosine
    dims: int | None = None
    encoding: str = "f32"


@dataclass(frozen=True)
class Graph:
    """complete: every edge's ends are vertices of their tables, so a vertex table is only read for its properties."""

    vertices: tuple[VertexTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    complete: bool = True
    schema: tuple | None = None
    unique: tuple[tuple[str, bool, tuple[str, ...]], ...] = ()  # (label, of edges, properties)

    def table_no(self, name: str) -> int:
        return next(i for i, t in enumerate(self.vertices) if t.name == name)

    def edge_no(self, name: str) -> int:
        return next(i for i, t in enumerate(self.edges) if t.name == name)

    def with_vertices(self, label: str | tuple[str, ...], df: DataFrame, key: str, props: list[str] | None = None, name: str | None = None, labels_column: str | None = None) -> Graph:
        """Add df's rows as vertices.  Columns other than the key can be properties too; the key is one as well."""
        labels = frozenset([label] if isinstance(label, str) else label)
        skip = {labels_column}
        cols = [col(key).alias("k"), *(col(c).alias(f"p@{c}") for c in (props or df.columns) if c not in skip)]
        if labels_column:
            cols.append(col(labels_column).alias("ls"))
        t = VertexTable(name or "&".join(sorted(labels)) or "vertices", labels, df.select(*cols), labels_column is not None)
        return replace(self, vertices=(*self.vertices, t))

    def with_edges(self, label: str | None, df: DataFrame, src: tuple[str | None, str], dst: tuple[str | None, str], props: list[str] | None = None, key: str | None = None, name: str | None = None, directed: bool = True, src_table: str | None = None, dst_table: str | None = None) -> Graph:
        """Add df's rows as edges; src and dst are (vertex table, column).

        key names a column that tells the edges of the table apart, and their order; by default it is a hash
        of the row.  Where the vertex table is None, src_table or dst_table names a column with table names.
        """
        cols = [(col(key) if key else F.xxhash64(*(col(c) for c in df.columns))).cast("long").alias("e"), col(src[1]).alias("s"), col(dst[1]).alias("d")]
        for one, column, short in ((src[0], src_table, "st"), (dst[0], dst_table, "dt")):
            if one is None:
                no = None
                for i, t in enumerate(self.vertices):
                    no = F.when(col(column) == t.name, i) if no is None else no.when(col(column) == t.name, i)
                cols.append(no.cast("int").alias(short))
        cols += [col(c).alias(f"p@{c}") for c in (df.columns if props is None else props)]
        t = EdgeTable(name or (label or "edges") + (f"_{len(self.edges)}" if any(e.name == (label or "edges") for e in self.edges) else ""), label, df.select(*cols), src[0], dst[0], directed)
        return replace(self, edges=(*self.edges, t))

    def labels(self) -> set[str]:
        return {x for t in self.vertices for x in t.labels}


class Catalog:
    """Graphs, graph types and indexes by name."""

    def __init__(self) -> None:
        self.graphs: dict[str, Graph] = {}
        self.types: dict[str, list[dict]] = {}
        self.schemas: set[str] = set()
        self.indexes: dict[str, dict] = {}
        self.vectors: dict[str, VectorIndex] = {}

    def graph(self, name: str) -> Graph:
        if name not in self.graphs:
            raise KeyError(f"no graph is named {name}")
        return self.graphs[name]
