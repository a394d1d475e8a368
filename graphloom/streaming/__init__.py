"""Graphs fed by streams; the query language itself has no streaming operators."""

from .ingest import follow

__all__ = ["follow"]
