"""Dates, times and durations; a value that doesn't parse is an error, as casts are strict."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = re.compile(r"(-)?P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+)(?:\.(\d{1,9}))?S)?)?")


def duration_parts(text: str) -> tuple[int, int]:
    """Months and nanoseconds of an ISO 8601 duration."""
    m = _ISO.fullmatch(text)
    if not m or text.endswith(("P", "T")):
        raise ValueError(f"{text!r} is no duration")
    years, months, weeks, days, hours, minutes, seconds = (int(x or 0) for x in m.groups()[1:8])
    nanos = (((weeks * 7 + days) * 24 + hours) * 60 + minutes) * 60 + seconds
    fraction = int((m[9] or "0").ljust(9, "0"))
    nanos = nanos * 10**9 + (-fraction if (m[8] or "").startswith("-") else fraction)
    sign = -1 if m[1] else 1
    return sign * (12 * years + months), sign * nanos


def duration(months: Column, nanos: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), nanos.cast("long").alias("nanos"))


def between(a: Column, b: Column, unit: str) -> Column:
    if unit == "YEAR TO MONTH":
        return duration(F.months_between(b, a).cast("int"), F.lit(0))
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return duration(F.lit(0), micros * 1000)


def construct(name: str, x: Column, literal: str | None) -> Column:
    if name == "DURATION":
        if literal is not None:
            return duration(*map(F.lit, duration_parts(literal)))
        part = lambda i: F.coalesce(F.nullif(F.regexp_extract(x, _ISO.pattern, i), F.lit("")).cast("long"), F.lit(0))
        sign = F.when(F.regexp_extract(x, _ISO.pattern, 1) == "-", -1).otherwise(1)
        fraction = F.rpad(F.regexp_extract(x, _ISO.pattern, 9), 9, "0").cast("long")
        nanos = ((((part(4) * 7 + part(5)) * 24 + part(6)) * 60 + part(7)) * 60 + part(8)) * F.lit(10**9) + F.coalesce(fraction, F.lit(0))
        ok = F.assert_true(x.isNull() | x.rlike(f"^{_ISO.pattern}$"), F.lit("no duration"))
        return F.when(x.isNotNull() & ok.isNull(), duration(sign * (part(2) * 12 + part(3)), sign * nanos))
    kind = {"DATE": "date", "TIME": "time", "LOCAL_TIME": "time", "ZONED_TIME": "time", "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "ZONED_DATETIME": "timestamp", "LOCAL_DATETIME": "timestamp_ntz"}[name]
    if name in ("ZONED_TIME", "ZONED_DATETIME"):
        offset = F.regexp_extract(x, r"([+-]\d\d):?(\d\d)?$", 0)
        sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
        hours = F.nullif(F.regexp_extract(x, r"[+-](\d\d):?(\d\d)?$", 1), F.lit("")).cast("int")
        minutes = F.nullif(F.regexp_extract(x, r"[+-](\d\d):?(\d\d)$", 2), F.lit("")).cast("int")
        zone = sign * (F.coalesce(hours, F.lit(0)) * 3600 + F.coalesce(minutes, F.lit(0)) * 60)
        if name == "ZONED_DATETIME":
            return F.when(x.isNotNull(), F.struct(x.cast("timestamp").alias("ts"), zone.alias("tz")))
        bare = F.regexp_replace(x, r"(Z|[+-]\d\d:?(\d\d)?)$", "")
        parts = F.split(bare, ":")
        second = F.coalesce(F.get(parts, F.lit(2)), F.lit("0")).cast("decimal(18,9)")
        nanos = (F.get(parts, F.lit(0)).cast("long") * 3600 + F.get(parts, F.lit(1)).cast("long") * 60) * F.lit(10**9) + (second * F.lit(10**9)).cast("long")
        return F.when(x.isNotNull(), F.struct(nanos.alias("nanos"), zone.alias("tz")))
    return x.cast(kind)
