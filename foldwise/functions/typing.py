"""Result types and checks of fill values, at plan time."""

from __future__ import annotations

import math

from pyspark.sql import types as T

from .registry import BOOLEAN, COUNTS

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def base(func: str) -> str:
    return func[3:] if func.startswith("nan") else func


def result_type(func: str, value: T.DataType, dtype: T.DataType | None = None) -> T.DataType:
    """The type of a function's result for values of a type; `dtype` is the caller's wish."""
    name = base(func)
    if isinstance(dtype, T.BooleanType) and "all" not in name and "any" not in name:
        raise TypeError(f"{func} is not boolean")
    if name == "len" and dtype is not None and not isinstance(dtype, INTEGRAL):
        raise TypeError("len needs an integer type")
    if dtype is not None:
        return dtype
    if func in BOOLEAN:
        return T.BooleanType()
    if func in COUNTS:
        return T.LongType()
    if name == "array":
        return T.ArrayType(value)
    if name in ("sum", "cumsum", "sumofsquares"):
        return T.LongType() if isinstance(value, (*INTEGRAL, T.BooleanType)) else value if isinstance(value, T.StructType) else T.DoubleType()
    if name in ("prod", "cumprod", "var", "std"):
        return T.DoubleType()
    if name == "mean":
        return value if isinstance(value, T.StructType) else T.DoubleType()
    return value


def checked_fill(func: str, kind: T.DataType, fill: object) -> T.DataType:
    """The type that holds both results and the fill value; ValueError if none does."""
    nothing = fill is None or isinstance(fill, float) and math.isnan(fill)
    if isinstance(kind, T.ArrayType):
        if not (fill is None or isinstance(fill, (list, tuple)) and not fill):
            raise ValueError("lists are filled with None or an empty list")
        return kind
    if isinstance(kind, T.BooleanType):
        if nothing or fill not in (0, 1, True, False):
            raise ValueError(f"{func} is filled with a boolean")
        return kind
    if isinstance(kind, INTEGRAL):
        if nothing:
            raise ValueError(f"{func} has integer results, which {fill!r} is not")
        return kind if float(fill).is_integer() else T.DoubleType()
    return kind
