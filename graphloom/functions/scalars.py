"""Functions by name: arguments are columns, the result is a column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType


def _log(base: Column, x: Column) -> Column:
    ok = (base > 0) & (base != 1) & (x > 0)
    return F.when(ok, F.ln(x.cast("double")) / F.ln(base.cast("double"))).when(base.isNotNull() & x.isNotNull(), F.raise_error(F.lit("LOG needs positive arguments")).cast("double"))


def _domain(f: Callable[[Column], Column], ok: Callable[[Column], Column], name: str) -> Callable[[Column], Column]:
    def run(x: Column) -> Column:
        x = x.cast("double")
        return F.when(ok(x), f(x)).when(x.isNotNull(), F.raise_error(F.lit(f"{name}: argument out of range")).cast("double"))

    return run


def _real(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x.cast("double"))


SIMPLE: dict[str, Callable[..., Column]] = {
    "ABS": F.abs,
    "MOD": lambda a, b: a % b,
    "FLOOR": F.floor,
    "CEIL": F.ceil,
    "CEILING": F.ceil,
    "SQRT": _domain(F.sqrt, lambda x: x >= 0, "SQRT"),
    "EXP": _real(F.exp),
    "LN": _domain(F.ln, lambda x: x > 0, "LN"),
    "LOG10": _domain(F.log10, lambda x: x > 0, "LOG10"),
    "LOG": _log,
    "POWER": lambda a, b: F.pow(a.cast("double"), b.cast("double")),
    "SIN": _real(F.sin),
    "COS": _real(F.cos),
    "TAN": _real(F.tan),
    "COT": _real(F.cot),
    "ASIN": _domain(F.asin, lambda x: F.abs(x) <= 1, "ASIN"),
    "ACOS": _domain(F.acos, lambda x: F.abs(x) <= 1, "ACOS"),
    "ATAN": _real(F.atan),
    "ATAN2": lambda a, b: F.atan2(a.cast("double"), b.cast("double")),
    "SINH": _real(F.sinh),
    "COSH": _real(F.cosh),
    "TANH": _real(F.tanh),
    "DEGREES": _real(F.degrees),
    "RADIANS": _real(F.radians),
    "SIGN": F.signum,
    "TRUNC": lambda x, n=None: F.when(x >= 0, F.floor(x * F.pow(F.lit(10.0), n if n is not None else F.lit(0)))).otherwise(F.ceil(x * F.pow(F.lit(10.0), n if n is not None else F.lit(0)))) / F.pow(F.lit(10.0), n if n is not None else F.lit(0)),
    "ROUND": lambda x, n=None: F.round(x, n) if n is not None else F.round(x),
    "UPPER": F.upper,
    "LOWER": F.lower,
    "LEFT": F.left,
    "RIGHT": F.right,
    "BTRIM": lambda s, c=None: F.btrim(s, c) if c is not None else F.btrim(s),
    "LTRIM": lambda s, c=None: F.ltrim(s, c) if c is not None else F.ltrim(s),
    "RTRIM": lambda s, c=None: F.rtrim(s, c) if c is not None else F.rtrim(s),
    "CHAR_LENGTH": F.char_length,
    "CHARACTER_LENGTH": F.char_length,
    "BYTE_LENGTH": F.octet_length,
    "OCTET_LENGTH": F.octet_length,
    "COALESCE": F.coalesce,
    "NULLIF": F.nullif,
    "CURRENT_DATE": F.current_date,
    "CURRENT_TIME": F.current_time,
    "LOCAL_TIME": F.current_time,
    "CURRENT_TIMESTAMP": F.current_timestamp,
    "LOCAL_TIMESTAMP": F.localtimestamp,
    "TRIM_LIST": lambda x, n: F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0))),
}

#: Those that read the session, not the row.
SESSION = {"SESSION_USER", "MSG_CALLER"}


def normalize(x: Column, form: str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return run(x)


def is_normalized(x: Column, form: str) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.is_normalized(form, v), na_action="ignore")

    return run(x)


_CASTS = {"BOOL": "boolean", "BOOLEAN": "boolean", "INT8": "byte", "INTEGER8": "byte", "INT16": "short", "SMALLINT": "short", "INTEGER16": "short", "INT32": "int", "INTEGER32": "int", "INT": "long", "INTEGER": "long", "INT64": "long", "INTEGER64": "long", "BIGINT": "long", "SIGNED INTEGER": "long", "INT128": "decimal(38,0)", "INTEGER128": "decimal(38,0)", "UINT8": "short", "UINT16": "int", "UINT32": "long", "UINT64": "decimal(20,0)", "UINT": "decimal(20,0)", "USMALLINT": "int", "UBIGINT": "decimal(20,0)", "UINT128": "decimal(38,0)", "FLOAT16": "float", "FLOAT32": "float", "FLOAT": "double", "FLOAT64": "double", "REAL": "float", "DOUBLE": "double", "DOUBLE PRECISION": "double", "FLOAT128": "double", "DECIMAL": "decimal(28,10)", "DEC": "decimal(28,10)", "STRING": "string", "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "BYTES": "binary", "BINARY": "binary", "VARBINARY": "binary", "DATE": "date", "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "ZONED DATETIME": "timestamp", "LOCAL DATETIME": "timestamp_ntz", "LOCAL TIMESTAMP": "timestamp_ntz", "TIME": "time", "LOCAL TIME": "time"}
_UNSIGNED = {"UINT8": 2**8, "UINT16": 2**16, "UINT32": 2**32, "UINT64": 2**64, "UINT": 2**64, "USMALLINT": 2**16, "UBIGINT": 2**64}


def spark_type(name: str) -> str:
    base = name.removesuffix(" NOT NULL")
    if "(" in base and base.split("(")[0] in ("DECIMAL", "DEC"):
        return "decimal" + base[base.index("(") :].replace(")", ",0)" if "," not in base else ")")
    if base.startswith(("LIST<", "ARRAY<")):
        return f"array<{spark_type(base[base.index('<') + 1 : -1])}>"
    base = base.split("(")[0]
    if base not in _CASTS:
        raise ValueError(f"type {name} is not known")
    return _CASTS[base]


def cast(x: Column, name: str) -> Column:
    out = x.cast(spark_type(name))
    top = _UNSIGNED.get(name.removesuffix(" NOT NULL"))
    if top:
        ok = F.assert_true(x.isNull() | (out >= 0) & (out < F.lit(top).cast("decimal(38,0)")), F.lit(f"value out of the range of {name}"))
        out = F.when(ok.isNull(), out)
    return out


def is_type(kind: DataType, name: str) -> bool:
    """Whether a Spark type is what the query language's type name stands for."""
    base = name.removesuffix(" NOT NULL").split("(")[0]
    if base.startswith(("LIST", "ARRAY")):
        return isinstance(kind, ArrayType)
    want = _CASTS.get(base)
    if want is None:
        raise ValueError(f"type {name} is not known")
    if want.startswith("decimal"):
        return isinstance(kind, DecimalType)
    return kind.simpleString() == {"long": "bigint", "short": "smallint", "byte": "tinyint"}.get(want, want)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


VECTOR: dict[str, Callable[[Column, Column], Column]] = {"VECTOR.L2_SQUARED": l2_squared, "VECTOR.COSINE_DISTANCE": lambda a, b: F.lit(1.0) - cosine_similarity(a, b), "VECTOR.COSINE_SIMILARITY": cosine_similarity, "VECTOR.DOT": dot}

