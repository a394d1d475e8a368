"""Graphs from files, and back."""

from .bulk import BulkLoad
from .loader import load_document, load_lines, load_rows
from .store import read_graph, write_graph

__all__ = ["BulkLoad", "load_document", "load_lines", "load_rows", "read_graph", "write_graph"]
