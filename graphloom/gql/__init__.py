"""The graph query language: text to syntax trees and back."""

from .formatter import format_program
from .parser import ParseError, parse

__all__ = ["ParseError", "format_program", "parse"]
