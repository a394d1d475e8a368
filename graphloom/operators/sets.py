"""Set operations on results, whose columns meet by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(op: str, every: bool, a: DataFrame, b: DataFrame) -> DataFrame:
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"{op} needs the same columns on both sides, not {a.columns} and {b.columns}")
    b = b.select(*(F.col("`" + c.replace("`", "``") + "`") for c in a.columns))
    if op == "UNION":
        return a.union(b) if every else a.union(b).distinct()
    if op == "EXCEPT":
        return a.exceptAll(b) if every else a.subtract(b)
    if op == "INTERSECT":
        return a.intersectAll(b) if every else a.intersect(b)
    # OTHERWISE: b only where a has no row, decided in the plan, not on the driver
    some = a.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    return a.union(b.join(F.broadcast(some), ~F.col("_some")).drop("_some"))
