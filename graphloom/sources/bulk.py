"""Bulk loads in chunks: start, any number of chunks in any order and again, finalize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from .loader import load_rows


class BulkLoad:
    """Chunks land in folders of their own, so one that is sent again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.state = spark, path.rstrip("/"), "started"
        self.chunks: dict[str, set[str]] = {"vertices": set(), "edges": set()}

    def add(self, kind: str, chunk: str | int, rows: DataFrame) -> None:
        if self.state != "started":
            raise ValueError(f"the load is {self.state}")
        if kind not in self.chunks:
            raise ValueError("a chunk holds vertices or edges")
        rows.write.mode("overwrite").json(f"{self.path}/{kind}/chunk={chunk}")
        self.chunks[kind].add(str(chunk))

    def status(self) -> dict:
        return {"state": self.state, "vertices": len(self.chunks["vertices"]), "edges": len(self.chunks["edges"])}

    def finalize(self) -> Graph:
        read = lambda kind: self.spark.read.json(f"{self.path}/{kind}").drop("chunk") if self.chunks[kind] else None
        v = read("vertices")
        graph = load_rows(v, read("edges")) if v is not None else Graph()
        self.state = "finalized"
        return graph
