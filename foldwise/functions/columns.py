"""The functions as columns. A result is null where the group gets the fill value.

`a` is the value, `p` the position. In floating values NaN is the missing marker, and null reads as NaN.
Spark skips nulls but not NaN, and orders NaN above all numbers: each function says what NaN does to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .typing import FLOATING, INTEGRAL, base


def nan() -> Column:
    return F.lit(float("nan"))


@dataclass
class Values:
    """A value column with its position, type and options; `skip` leaves NaN out."""

    a: Column
    p: Column | None
    kind: T.DataType
    ddof: int = 0
    skip: bool = False

    def __post_init__(self) -> None:
        self.floating = isinstance(self.kind, FLOATING)
        if isinstance(self.kind, T.BooleanType):
            self.a = self.a.cast("int")
        if self.floating:
            self.a = F.coalesce(self.a, nan().cast(self.kind))
        self.isnan = F.isnan(self.a) if self.floating else F.lit(False)
        self.kept = F.when(~self.isnan, self.a) if self.skip and self.floating else self.a
        self.wide = self.kept.cast("long") if isinstance(self.kind, (*INTEGRAL, T.BooleanType)) else self.kept.cast("double")
        self.at = F.when(~self.isnan, self.p) if self.skip and self.floating and self.p is not None else self.p


def _spread(v: Values) -> Column:
    n = F.count(v.kept)
    return F.when(n > v.ddof, F.var_pop(v.kept.cast("double")) * n / F.when(n > v.ddof, n - v.ddof))


def _low(v: Values) -> Column:
    if v.floating and not v.skip:
        return F.when(F.bool_or(v.isnan), nan().cast(v.kind)).otherwise(F.min(v.a))
    return F.min(v.kept)


def _arg(best: Callable, v: Values, after: Column) -> Column:
    """The position of the best value, the smallest on ties; none if a NaN stands in a group that doesn't skip it."""
    found = best(v.at, F.when(v.at.isNotNull(), F.struct(v.a, after)))
    return F.when(~F.bool_or(v.isnan), found) if v.floating and not v.skip else found


def _complex(part: Callable[[Column], Column]) -> Callable[[Values], Column]:
    """Sums and means of complex numbers (struct re, im), part by part."""
    return lambda v: F.struct(part(v.a["re"]).alias("re"), part(v.a["im"]).alias("im"))


REDUCE: dict[str, Callable[[Values], Column]] = {
    "sum": lambda v: _complex(F.sum)(v) if isinstance(v.kind, T.StructType) else F.sum(v.wide),
    "prod": lambda v: F.product(v.wide),
    "len": lambda v: F.nullif(F.count(v.kept), F.lit(0)) if v.skip else F.count(v.a),
    "mean": lambda v: _complex(F.avg)(v) if isinstance(v.kind, T.StructType) else F.avg(v.kept.cast("double")),
    "var": _spread,
    "std": lambda v: F.sqrt(_spread(v)),
    "min": _low,
    "max": lambda v: F.max(v.kept),
    "first": lambda v: F.min_by(v.a, v.at),
    "last": lambda v: F.max_by(v.a, v.at),
    "argmax": lambda v: _arg(F.max_by, v, -v.at),
    "argmin": lambda v: _arg(F.min_by, v, v.at),
    "sumofsquares": lambda v: F.sum(v.wide * v.wide),
    "all": lambda v: F.bool_and(v.kept != 0),
    "any": lambda v: F.bool_or(v.kept != 0),
    "allnan": lambda v: F.bool_and(v.isnan),
    "anynan": lambda v: F.bool_or(v.isnan),
}


def _running_low(v: Values, w: WindowSpec) -> Column:
    low = F.min(v.kept).over(w)
    return F.when(F.bool_or(v.isnan).over(w), nan().cast(v.kind)).otherwise(low) if v.floating and not v.skip else low


#: Running functions over a window from the group's beginning to the row; sums and products of nothing
#: are 0 and 1, extrema of nothing get the fill value.
RUN: dict[str, Callable[[Values, WindowSpec], Column]] = {
    "cumsum": lambda v, w: F.coalesce(F.sum(v.wide).over(w), F.lit(0)),
    "cumprod": lambda v, w: F.coalesce(F.product(v.wide).over(w), F.lit(1.0)),
    "cummax": lambda v, w: F.max(v.kept).over(w),
    "cummin": _running_low,
}


def reduction(func: str, v: Values) -> Column:
    return REDUCE[base(func)](v)
