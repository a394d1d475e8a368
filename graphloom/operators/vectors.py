"""Exact nearest vectors."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine_similarity, dot, l2_squared


def in_bytes(v: Column) -> Column:
    """A vector as signed bytes would keep it: multiples of its largest magnitude over 127."""
    v = F.transform(v, lambda x: x.cast("double"))
    top = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda x: F.when(top == 0, 0.0).otherwise(F.round(x / top * 127) * top / 127))


def nearest(df: DataFrame, vector: Column, query: list[Any], metric: str, dims: int | None, k: int, ties: list[Column], name: str, encoding: str = "f32") -> DataFrame:
    """The k rows nearest to query with their squared distance, or their cosine similarity, as column name.

    With encoding i8 rows, not the query, are compared as signed bytes would keep them.  Each task keeps k rows, the last merges them.  Null vectors, those of another length, with values that
    are not finite, or, for cosine, of no length are no candidates.  Ties go by the columns in ties.
    """
    q = [float(x) for x in query]
    if not q or not all(map(math.isfinite, q)) or metric == "cosine" and not any(q):
        raise ValueError("the query vector must be finite and, for cosine, not zero")
    if dims is not None and len(q) != dims:
        raise ValueError(f"the index has {dims} dimensions, the query {len(q)}")
    lit = F.lit(q).cast("array<double>")
    fits = vector.isNotNull() & (F.size(vector) == len(q)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if metric == "cosine":
        fits = fits & F.exists(vector, lambda x: x != 0)
        score = cosine_similarity(vector, lit)
        if encoding == "i8":  # rows are made unit vectors, then bytes
            norm = F.sqrt(dot(vector, vector))
            score = dot(in_bytes(F.transform(vector, lambda x: x.cast("double") / norm)), lit) / math.sqrt(sum(x * x for x in q))
        out = df.where(fits).withColumn(name, score)
        return out.orderBy(F.col(f"`{name}`").desc(), *ties).limit(k)
    return df.where(fits).withColumn(name, l2_squared(in_bytes(vector) if encoding == "i8" else vector, lit)).orderBy(F.col(f"`{name}`").asc(), *ties).limit(k)
