"""Aggregate functions: their treatment of nulls, duplicates and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _when(x: Column, keep: Column | None) -> Column:
    return x if keep is None else F.when(keep, x)


def ordering(keys: list[tuple[Column, bool, bool | None]]):
    """Sort columns; by default nulls come last ascending and first descending."""
    out = []
    for c, up, nulls in keys:
        first = (not up) if nulls is None else nulls
        out.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()))
    return out


def _compare(keys: list[tuple[bool, bool | None]]):
    def run(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (up, nulls) in reversed(list(enumerate(keys))):
            x, y = a[f"k{i}"], b[f"k{i}"]
            first = (not up) if nulls is None else nulls
            low, high = (-1, 1) if up else (1, -1)
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1 if first else 1).when(y.isNull(), 1 if first else -1).when(x < y, low).when(x > y, high).otherwise(out)
        return out

    return run


def aggregate(name: str, args: list[Column], distinct: bool, keep: Column | None = None, order: list[tuple[Column, bool, bool | None]] | None = None, times: Column | None = None) -> Column:
    """keep: only rows where it is true count; order: that of a collected list; times: how many rows each row counts for."""
    if times is not None and name in ("COUNT(*)", "COUNT") and not distinct:
        there = keep if name == "COUNT(*)" else _when(args[0], keep).isNotNull()
        return F.coalesce(F.sum(_when(times, there)), F.lit(0).cast("long"))
    if name == "COUNT(*)":
        return F.count(_when(F.lit(1), keep))
    x = _when(args[0], keep)
    if name == "COUNT":
        return F.count_distinct(x) if distinct else F.count(x)
    if name == "SUM":
        return F.sum_distinct(x) if distinct else F.sum(x)
    if name == "AVG":
        return (F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x)).cast("double")
    if name == "MIN":
        return F.min(x)
    if name == "MAX":
        return F.max(x)
    if name == "STDDEV_SAMP":
        return _spread(F.stddev_samp, x, distinct)
    if name == "STDDEV_POP":
        return _spread(F.stddev_pop, x, distinct)
    if name in ("PERCENTILE_CONT", "PERCENTILE_DISC"):
        if len(args) != 2:
            raise ValueError(f"{name} takes a value and a share")
        if name == "PERCENTILE_CONT" and not distinct:
            return F.percentile(x, args[1])
        items = F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
        n = F.size(items)
        if name == "PERCENTILE_DISC":
            return F.get(items, F.greatest(F.ceil(args[1] * n).cast("int") - 1, F.lit(0)))
        place = args[1] * (n - 1)
        low = F.get(items, F.floor(place).cast("int")).cast("double")
        return low + (F.get(items, F.ceil(place).cast("int")).cast("double") - low) * (place - F.floor(place))
    if name == "COLLECT_LIST":
        fields = [args[0].alias("x"), *(c.alias(f"k{i}") for i, (c, _, _) in enumerate(order or []))]
        items = F.collect_list(_when(F.struct(*fields), keep))  # in a struct, so that nulls stay
        if order:
            items = F.array_sort(items, _compare([(up, nulls) for _, up, nulls in order]))
        items = F.transform(items, lambda s: s["x"])
        return F.array_distinct(items) if distinct else items
    raise ValueError(f"aggregate {name} is not known")


def _spread(f, x: Column, distinct: bool) -> Column:
    if not distinct:
        return f(x)
    items = F.collect_set(x.cast("double"))
    n = F.size(items)
    mean = F.aggregate(items, F.lit(0.0), lambda s, y: s + y) / n
    total = F.aggregate(items, F.lit(0.0), lambda s, y: s + y * y) - n * mean * mean
    less = 1 if f is F.stddev_samp else 0
    return F.when(n > less, F.sqrt(F.greatest(total, F.lit(0.0)) / (n - less)))
