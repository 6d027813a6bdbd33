"""The functions over one group's values in an array column, so within a row; null where the group gets the fill value.

`x` holds the values, `at` their places, both in order. NaN reads as in `columns`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import REDUCE, nan
from .typing import FLOATING, INTEGRAL, base


def _total(x: Column, zero: Column, term: Callable[[Column], Column], product: bool = False) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(x, zero, lambda s, v: s * term(v) if product else s + term(v)))


def _spread(x: Column, ddof: int) -> Column:
    n = F.size(x)
    mean = _total(x, F.lit(0.0), lambda v: v.cast("double")) / n
    # In a pair with its mean each value is met once more; the mean isn't made again for each.
    squares = F.aggregate(F.arrays_zip(x.alias("v"), F.array_repeat(mean, n).alias("m")), F.lit(0.0), lambda s, p: s + F.pow(p["v"].cast("double") - p["m"], F.lit(2)))
    return F.when(n > ddof, squares / F.when(n > ddof, n - ddof))


def reduced(func: str, x: Column, at: Column, kind: T.DataType, ddof: int) -> Column:
    """A reduction or the list of a group."""
    name, skip, floating = base(func), func not in REDUCE and func != "array", isinstance(kind, FLOATING)
    if isinstance(kind, T.StructType) and name in ("sum", "mean"):
        return F.when(F.size(x) > 0, F.struct(*(reduced(name, x[c], at, T.DoubleType(), 0).alias(c) for c in ("re", "im"))))
    isnan = (lambda v: F.isnan(v)) if floating else (lambda v: F.lit(False))
    kept = F.filter(x, lambda v: ~isnan(v)) if skip and floating else x
    some, whole = F.size(kept) > 0, isinstance(kind, (*INTEGRAL, T.BooleanType))
    number = (lambda v: v.cast("int")) if isinstance(kind, T.BooleanType) else (lambda v: v)
    wide = lambda v: number(v).cast("long" if whole else "double")
    zero = F.lit(0).cast("long") if whole else F.lit(0.0)
    clean = F.lit(True) if skip or not floating else ~F.exists(x, isnan)

    def arg(best: Column) -> Column:
        return F.when(clean & some, F.get(at, (F.array_position(x, best) - 1).cast("int")))

    if name == "sum":
        return _total(kept, zero, wide)
    if name == "prod":
        return _total(kept, F.lit(1.0), lambda v: number(v).cast("double"), product=True)
    if name == "len":
        return F.when(some, F.size(kept).cast("long"))
    if name == "mean":
        return _total(kept, F.lit(0.0), lambda v: number(v).cast("double")) / F.when(some, F.size(kept))
    if name in ("var", "std"):
        spread = _spread(F.transform(kept, number), ddof)
        return spread if name == "var" else F.sqrt(spread)
    if name == "min":
        return F.when(~clean, nan().cast(kind)).otherwise(F.array_min(kept)) if floating else F.array_min(kept)
    if name == "max":
        return F.array_max(kept)
    if name in ("first", "last"):
        return F.when(some, F.try_element_at(kept, F.lit(1 if name == "first" else -1)))
    if name in ("argmax", "argmin"):
        return arg(F.array_max(kept) if name == "argmax" else F.array_min(kept))
    if name == "sumofsquares":
        return _total(kept, zero, lambda v: wide(v) * wide(v))
    if name in ("all", "any"):
        return F.when(some, (F.forall if name == "all" else F.exists)(kept, lambda v: number(v) != 0))
    if name in ("allnan", "anynan"):
        return F.when(some, (F.forall if name == "allnan" else F.exists)(x, isnan))
    return F.when(F.size(x) > 0, x)


def running(func: str, x: Column, kind: T.DataType, fill: object) -> Column:
    """What a running function or a sort makes of a group: an array as long as `x`."""
    name, floating = base(func), isinstance(kind, FLOATING)
    isnan = (lambda v: F.isnan(v)) if floating else (lambda v: F.lit(False))
    if func == "sort":
        return F.array_sort(x)  # NaN last
    if func == "rsort":
        return F.concat(F.reverse(F.array_sort(F.filter(x, lambda v: ~isnan(v)))), F.filter(x, isnan))
    whole = isinstance(kind, (*INTEGRAL, T.BooleanType))
    if name in ("cumsum", "cumprod"):
        result = "long" if whole and name == "cumsum" else "double"
        value = lambda v: (v.cast("int") if isinstance(kind, T.BooleanType) else v).cast(result)
        start = F.lit(0 if name == "cumsum" else 1).cast(result)
        join = (lambda s, v: s + value(v)) if name == "cumsum" else (lambda s, v: s * value(v))
    else:
        result, start = kind.simpleString(), F.lit(None).cast(kind)
        best = F.greatest if name == "cummax" else F.least

        def join(s: Column, v: Column) -> Column:
            met = F.coalesce(best(s, v), v)
            return F.when(isnan(s) | isnan(v), nan().cast(kind)).otherwise(met) if floating and name == "cummin" else met

    step = (lambda s, v: F.when(isnan(v), s).otherwise(join(s, v))) if floating and func.startswith("nan") else join
    begin = F.struct(start.alias("s"), F.array().cast(f"array<{result}>").alias("done"))
    done = F.aggregate(x, begin, lambda acc, v: F.struct(step(acc["s"], v).alias("s"), F.array_append(acc["done"], step(acc["s"], v)).alias("done")))["done"]
    return F.transform(done, lambda v: F.coalesce(v, F.lit(fill).cast(kind))) if name in ("cummax", "cummin") else done
