"""Grouped aggregation by integer labels: reductions, running functions, sorts, lists and callables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import REDUCE, RUN, Values, nan, reduction
from ..functions.registry import LISTS, NEEDS_POS, RUNNING, SORTS, resolve
from ..functions.typing import FLOATING, INTEGRAL, base, checked_fill, result_type
from .dense import check_now, checked_label, checked_value, declared, densified, inferred, place, whole

Func = str | Callable


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _checked(df: DataFrame, by: list[str], value: object, pos: str | None, funcs: list[Func], ddof: int) -> None:
    """What can be told from the schema."""
    for c in by:
        if not isinstance(df.schema[c].dataType, INTEGRAL):
            raise TypeError(f"labels are integers, {c} is {df.schema[c].dataType.simpleString()}")
    for f in funcs:
        if callable(f) or f in NEEDS_POS:
            if pos is None:
                raise ValueError(f"{f} depends on the rows' order: name the position column (pos)")
        if not isinstance(value, str) and f not in ("sum", "prod", "len"):
            raise ValueError(f"a scalar value only suits sum, prod and len, not {f}")
        if ddof and base(f if isinstance(f, str) else "") not in ("var", "std"):
            raise TypeError("ddof is for var and std")


def group_aggregate(
    df: DataFrame, by: str | Sequence[str], value: str | float, func: Func | Sequence[Func] = "sum", *, pos: str | None = None, size: int | Sequence[int] | None = None,
    fill_value: object = 0, ddof: int = 0, dtype: T.DataType | None = None, order: str = "C", over: str | Sequence[str] = (), dense: bool = True, validate: bool = True, eager: bool = False, reverse: bool = False, out: str | None = None,
) -> DataFrame:
    """Aggregates `value` by the labels `by`.

    Reductions and lists give a row per label combination below `size` (inferred as the greatest label
    plus one), with `fill_value` where no row had it; several labels also give `index`, their place in an array
    of that shape, row-major (order C) or column-major (F). dense=False gives only the labels met. `over`
    names further key columns, the other axes of an array. Running functions and sorts give the input's rows
    with one more column. Several functions make several columns from one scan and one shuffle.

    Functions of the rows' order need `pos`. In floating values null reads as NaN; other null values, null,
    negative or too large labels and no rows without a size are errors, raised when the plan runs; with `eager` they
    are ValueErrors of a small job ahead. With validate=False rows of such labels give no result. No job runs while
    the plan is made otherwise: sizes not given are taken from the grouped result, which is shuffled once and read twice
    (with callables, from another scan of the labels). A callable gets a group's values, ordered, as a pandas
    Series; its group has to fit one task's memory.
    """
    by, over = _names(by), _names(over)
    several = not (isinstance(func, str) or callable(func))
    funcs = [resolve(f) for f in (func if several else [func])]
    if reverse:
        funcs = ["rsort" if f == "sort" else f for f in funcs]
    _checked(df, by, value, pos, funcs, ddof)
    names = [f if isinstance(f, str) else getattr(f, "__name__", "callable") for f in funcs] if several else [out or "value"]
    scalar = not isinstance(value, str)
    kind = (T.LongType() if isinstance(value, int) else T.DoubleType()) if scalar else df.schema[value].dataType
    sizes = declared(by, size)
    unchecked = None if scalar or isinstance(kind, FLOATING) else value
    if eager:
        check_now(df, by, sizes, unchecked)
    elif validate and unchecked:
        df = df.withColumn(value, checked_value(value))

    a = F.lit(value) if scalar else F.col(value)
    p = F.col(pos) if pos else None
    running = [isinstance(f, str) and base(f) in (*RUNNING, *SORTS) for f in funcs]
    if any(running):
        if not all(running):
            raise ValueError("functions that keep the rows and functions that reduce them don't mix")
        if validate and not eager:
            df = df.withColumns({c: checked_label(c, n) for c, n in zip(by, sizes or [None] * len(by), strict=True)})
        for f, name in zip(funcs, names, strict=True):
            df = _sorted(df, by + over, value, pos, f == "rsort", name) if f in SORTS else _run(df, by + over, a, pos, kind, f, fill_value, name)
        return df

    kinds = [_kind(f, kind, dtype, fill_value) for f in funcs]
    calls = [f for f in funcs if callable(f)]
    if calls:
        got = _called(df, by + over, value, pos, calls, dtype)
        got = got.toDF(*by, *over, *(f"__{i}" for i, f in enumerate(funcs) if callable(f)))
    plain = [(i, f) for i, f in enumerate(funcs) if not callable(f)]
    if plain:
        made = df.groupBy(*over, *by).agg(*(_column(f, a, p, kind, ddof, value if scalar else None).alias(f"__{i}") for i, f in plain))
        got = made if not calls else made.join(got, by + over)
    if validate and not eager:
        got = got.withColumns({c: checked_label(c, n) for c, n in zip(by, sizes or [None] * len(by), strict=True)})
    if dense:
        # The join below keeps no null label; said here, its filter is the same wherever `got` is read.
        for c in by:
            got = got.where(F.col(c).isNotNull())
    high = inferred(df if calls else whole(got), by, validate) if sizes is None else None
    if dense:
        got = densified(got, by, over, sizes, order, high)
    elif len(by) > 1:
        shape = [f"__size{k}" for k in range(len(by))] if sizes is None else [f"{s}L" for s in sizes]
        known = {n: high.select(n).scalar() for n in shape} if sizes is None else {}
        got = got.withColumns(known).withColumn("index", place(by, shape, order))
    result = [F.coalesce(F.col(f"__{i}").cast(k), _fill(fill_value, k)).alias(n) for i, (k, n) in enumerate(zip(kinds, names, strict=True))]
    return got.select(*over, *by, *(["index"] if len(by) > 1 and "index" in got.columns else []), *result)


def _kind(func: Func, kind: T.DataType, dtype: T.DataType | None, fill: object) -> T.DataType:
    if callable(func):
        return dtype or T.DoubleType()
    # The default fill of 0 suits no list: lists of labels not met are then null.
    return checked_fill(func, result_type(func, kind, dtype), None if func in LISTS and fill == 0 and fill is not False else fill)


def _fill(fill: object, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.lit(None).cast(kind) if fill is None or fill == 0 else F.array().cast(kind)
    if isinstance(kind, T.StructType):
        return F.lit(None).cast(kind) if fill is None else F.struct(F.lit(float(fill)).alias("re"), F.lit(0.0).alias("im")).cast(kind)
    return F.lit(fill).cast(kind)


def _column(func: str, a: Column, p: Column | None, kind: T.DataType, ddof: int, scalar: float | None) -> Column:
    if scalar is not None and func == "sum":
        return F.count(F.lit(1)) * F.lit(scalar)
    if func == "array":
        return F.transform(F.sort_array(F.collect_list(F.struct(p.alias("p"), a.alias("a")))), lambda s: s["a"])
    return reduction(func, Values(a, p, kind, ddof, func not in REDUCE))


#: A label of more rows is hot: its rows run in parts of about so many.
PART_ROWS = 1 << 22
_TOTALS = {"cumsum": "sum", "cumprod": "prod", "cummax": "max", "cummin": "min"}


def _run(df: DataFrame, keys: list[str], a: Column, pos: str, kind: T.DataType, func: str, fill: object, name: str) -> DataFrame:
    """A running function. Where positions are whole numbers, a hot label is cut into parts of equal width in
    position: rows run within their part and add what the parts before come to. Hot labels and parts are broadcast;
    of either there are at most rows / PART_ROWS and a part more for each, some 500,000 for 10^12 rows."""
    skip, run = func.startswith("nan"), RUN[base(func)]
    v = Values(a, F.col(pos), kind, 0, skip)
    low = base(func) in ("cummax", "cummin")
    final = (lambda c: F.coalesce(c, F.lit(fill).cast(kind))) if low else (lambda c: c)
    upto = Window.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    if not isinstance(df.schema[pos].dataType, INTEGRAL):
        return df.withColumn(name, final(run(v, upto.partitionBy(*keys))))

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({c: f"__of_{c}" for c in on})
        met = F.lit(True)
        for c in on:
            met = met & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
        return left.join(F.broadcast(right), met, "left").drop(*(f"__of_{c}" for c in on))

    hot = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(pos).cast("double").alias("__from"), F.max(pos).cast("double").alias("__to")).where(F.col("__n") > PART_ROWS)
    share = (F.col(pos) - F.col("__from")) / (F.col("__to") - F.col("__from") + 1)
    rows = joined(df, hot, keys).withColumn("__part", F.floor(share * (F.col("__n") / PART_ROWS + 1))).drop("__n", "__from", "__to")
    parts = rows.where("__part is not null").groupBy(*keys, "__part").agg(REDUCE[_TOTALS[base(func)]](v).alias("__total"))
    total = Values(F.col("__total"), None, parts.schema["__total"].dataType, 0, skip)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__part")) == 1
    offsets = parts.select(*keys, "__part", run(total, before).alias("__before"), first.alias("__first")).where(~F.col("__first")).drop("__first")
    ran = joined(rows.withColumn(name, run(v, upto.partitionBy(*keys, "__part"))), offsets, [*keys, "__part"])
    here, there = F.col(name), F.col("__before")
    if base(func) == "cumsum":
        both = here + F.coalesce(there, F.lit(0))
    elif base(func) == "cumprod":
        both = here * F.coalesce(there, F.lit(1.0))
    elif base(func) == "cummax":
        both = F.greatest(here, there)
    else:
        both = F.least(here, there)
        if v.floating and not skip:
            both = F.when(F.isnan(here) | F.isnan(there), nan().cast(kind)).otherwise(both)
    return ran.withColumn(name, final(both)).select(*df.columns, name)


def _sorted(df: DataFrame, keys: list[str], value: str, pos: str, reverse: bool, name: str) -> DataFrame:
    """Each group's values in order, in the rows the group has; NaN last either way. The rows' ranks by
    position meet the values' ranks, so no group is gathered."""
    isnan = F.isnan(value) if isinstance(df.schema[value].dataType, FLOATING) else F.lit(False)
    by_value = F.col(value).desc() if reverse else F.col(value).asc()
    part = Window.partitionBy(*keys)
    rows = df.withColumn("__rank", F.row_number().over(part.orderBy(pos)))
    values = df.select(*keys, F.col(value).alias(name), F.row_number().over(part.orderBy(isnan, by_value, F.col(pos))).alias("__rank"))
    return rows.join(values, [*keys, "__rank"]).select(*df.columns, name)


def _called(df: DataFrame, keys: list[str], value: str, pos: str, funcs: list[Callable], dtype: T.DataType | None) -> DataFrame:
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(f"__f{i}", dtype or T.DoubleType()) for i in range(len(funcs)))])

    def call(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values(pos, kind="stable")[value].reset_index(drop=True)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), *(f(values) for f in funcs)]], columns=schema.names)

    return df.select(*keys, *dict.fromkeys([pos, value])).groupBy(*keys).applyInPandas(call, schema)


def broadcast_aggregate(df: DataFrame, by: str | Sequence[str], value: str, func: Func, *, pos: str | None = None, fill_value: object = 0, ddof: int = 0, dtype: T.DataType | None = None, out: str = "value") -> DataFrame:
    """Every row with its group's result: of a reduction, a list or a callable that of the group, by a join to the
    grouped result; running functions and sorts have a result a row, by a window. Labels are not checked."""
    by, name = _names(by), resolve(func)
    _checked(df, by, value, pos, [name], ddof)
    got = group_aggregate(df, by, value, name, pos=pos, fill_value=fill_value, ddof=ddof, dtype=dtype, dense=False, validate=False, out=out)
    if not callable(name) and base(name) in (*RUNNING, *SORTS):
        return got
    # Aggregates inside expressions would take the window one by one; the join keeps each as written.
    return unpack(df, got.select(*by, out), by)


def unpack(df: DataFrame, result: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Each row of `df` with what `result` has for its labels. The planner broadcasts a small result and
    splits hot labels of a large one."""
    return df.join(result, _names(by), "left")
