"""Copies of syntax trees with some parts replaced."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, is_dataclass
from typing import Any

from ..gql.ast import Expr


def replaced(x: Any, by: Callable[[Expr], Expr | None]) -> Any:
    """x with every expression for which by gives one replaced, from the outside in."""
    if isinstance(x, Expr) and (new := by(x)) is not None:
        return new
    if is_dataclass(x):
        return type(x)(**{f.name: replaced(getattr(x, f.name), by) for f in fields(x)})
    if isinstance(x, list):
        return [replaced(y, by) for y in x]
    if isinstance(x, tuple):
        return tuple(replaced(y, by) for y in x)
    if isinstance(x, dict):
        return {k: replaced(y, by) for k, y in x.items()}
    return x
