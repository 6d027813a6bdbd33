"""Aggregation along one axis of an array column of any depth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import reduced, running
from ..functions.columns import nan
from ..functions.registry import RUNNING, SORTS, resolve
from ..functions.typing import FLOATING, base
from .aggregate import Func, _checked, _fill, _kind, group_aggregate
from .dense import checked_value


def depth_of(kind: T.DataType) -> int:
    return 1 + depth_of(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def cells(df: DataFrame, array: str, depth: int = 1, prefix: str = "d") -> DataFrame:
    """A row per cell of an array column: `<prefix>1`.. are its places and `cell` its value."""
    out, last = df, array
    for k in range(1, depth + 1):
        if not isinstance(out.schema[last].dataType, T.ArrayType):
            raise TypeError(f"{array} is not an array of {depth} dimensions")
        kept = [c for c in out.columns if c != last]
        out = out.select(*kept, F.posexplode(last).alias(f"{prefix}{k}", "cell"))
        last = "cell"
    return out.withColumns({f"{prefix}{k}": F.col(f"{prefix}{k}").cast("long") for k in range(1, depth + 1)})


def _nth(k: Column, part: Column) -> Column:
    return F.get(part, k)


def vectors(df: DataFrame, array: str, axis: int, dims: list[str]) -> DataFrame:
    """A row for each vector along an axis (1 and up) of the arrays, which `array` then holds; `dims` name the
    places in the other axes. No shuffle: the axes before are exploded, those behind are picked place by place.
    Arrays whose parts differ in length are an error."""
    out, dims = df, list(dims)
    others = [c for c in df.columns if c != array]
    named: list[str] = []
    for _ in range(axis - 1):
        named.append(dims.pop(0))
        out = out.select(*others, *named[:-1], F.posexplode(array).alias(named[-1], array))
    for name in dims:
        even = F.forall(array, lambda part: F.size(part) == F.size(F.get(F.col(array), F.lit(0))))
        width = F.when(even, F.size(F.get(F.col(array), F.lit(0)))).otherwise(F.raise_error(F.lit(f"parts of {array} differ in length")).cast("int"))
        placed = out.where(F.size(array) > 0).withColumn("__width", width).where(F.col("__width") > 0)
        placed = placed.select(*others, *named, array, F.explode(F.expr("sequence(0, __width - 1)")).alias(name))
        out = placed.withColumn(array, F.transform(array, partial(_nth, F.col(name))))
        named.append(name)
    return out.withColumns({n: F.col(n).cast("long") for n in named})


def _groups(x: Column, labels: Sequence[int], size: int, dense: bool) -> Column:
    """Per label the cells of x at its places, as array<struct<label, cells: array<struct<i, a>>>>."""
    places: dict[int, list[int]] = {}
    for k, label in enumerate(labels):
        places.setdefault(label, []).append(k)
    used = F.array(*(F.struct(F.lit(g).cast("long").alias("label"), F.array(*map(F.lit, p)).alias("at")) for g, p in sorted(places.items())))
    if dense and len(places) < size:
        met = F.array(*(F.lit(g).cast("long") for g in sorted(places)))
        empty = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda g: ~F.array_contains(met, g))
        used = F.concat(used, F.transform(empty, lambda g: F.struct(g.alias("label"), F.array().cast("array<int>").alias("at"))))
    there = lambda at: F.filter(at, lambda i: i < F.size(x))
    return F.transform(used, lambda s: F.struct(s["label"].alias("label"), F.transform(there(s["at"]), lambda i: F.struct(i.alias("i"), F.get(x, i).alias("a"))).alias("cells")))


def axis_aggregate(df: DataFrame, array: str, func: Func | Sequence[Func], axis: int, *, row: str, labels: str | Sequence[int], size: int | None = None, **options) -> DataFrame:
    """Aggregates an array of any number of dimensions along an axis: rows of `df`, ordered by `row`, are axis 0
    and the nested arrays of a column the others; negative axes count from the end.

    Along axis 0 `labels` names the column of the rows' labels, and the result has a row per place in the other
    axes (dim, or dim1, dim2, .. of deeper arrays) and label. Along another axis labels is a sequence, one for each
    place there, and the result has a row per row, place in the remaining axes and label. Positions, so of argmax and
    argmin, are places along the axis. Running functions and sorts keep a row per cell (d<axis> and cell).
    All that lies along such an axis lies in one row and is aggregated there, without a shuffle; callables get
    their groups by one. Null and empty arrays give no rows; arrays longer than the labels are errors.
    """
    depth = depth_of(df.schema[array].dataType)
    if not depth:
        raise TypeError(f"{array} is not an array")
    if not -depth - 1 <= axis <= depth:
        raise ValueError(f"an array of {depth + 1} dimensions has the axes {-depth - 1} to {depth}, not {axis}")
    axis %= depth + 1
    names = {k: "dim" if depth == 1 else f"dim{k}" for k in range(1, depth + 1)}
    if axis == 0:
        if not isinstance(labels, str):
            raise ValueError("along axis 0 the labels are a column")
        tall = cells(df, array, depth).withColumnsRenamed({f"d{k}": n for k, n in names.items()})
        return group_aggregate(tall, labels, "cell", func, pos=row, size=size, over=list(names.values()), **options)
    if isinstance(labels, str):
        raise NotImplementedError("along this axis the labels are one sequence")
    if any(isinstance(x, bool) or not isinstance(x, int) for x in labels):
        raise TypeError("labels are integers")
    if any(x < 0 for x in labels):
        raise ValueError("negative labels")
    size = size or max(labels) + 1
    if max(labels) >= size:
        raise ValueError(f"labels reach {max(labels)}, beyond the size {size}")
    dims = [n for k, n in names.items() if k != axis]
    flat, place = vectors(df, array, axis, dims), f"d{axis}"
    short = F.size(array) <= len(labels)
    flat = flat.where(F.size(array) > 0).withColumn(array, F.when(short, F.col(array)).otherwise(F.raise_error(F.lit(f"arrays hold more than the {len(labels)} labelled places"))))
    several = not (isinstance(func, str) or callable(func))
    funcs = [resolve(f) for f in (func if several else [func])]
    if options.pop("reverse", False):
        funcs = ["rsort" if f == "sort" else f for f in funcs]
    if any(map(callable, funcs)):
        known = F.element_at(F.array(*(F.lit(x).cast("long") for x in labels)), (F.col(place) + 1).cast("int"))
        tall = cells(flat, array).withColumnRenamed("d1", place).withColumn("label", known)
        return group_aggregate(tall, "label", "cell", func, pos=place, size=size, over=[row, *dims], **options)
    return _within(flat, array, funcs, several, row, dims, place, labels, size, **options)


def _within(
    flat: DataFrame, array: str, funcs: list[str], several: bool, row: str, dims: list[str], place: str, labels: Sequence[int], size: int,
    fill_value: object = 0, ddof: int = 0, dtype: T.DataType | None = None, dense: bool = True, validate: bool = True, eager: bool = False, out: str | None = None, order: str = "C",
) -> DataFrame:
    """The groups of each row's vector, aggregated within the row. `order` has no say in one label; `eager` neither,
    for labels are known and checked when the plan is made."""
    kind = flat.schema[array].dataType.elementType
    _checked(flat, [], array, place, funcs, ddof)
    names = funcs if several else [out or "value"]
    grouped = flat.select(*(c for c in flat.columns if c != array), F.explode(_groups(F.col(array), labels, size, dense)).alias("__g"))
    a = F.col("__g.cells.a")
    if isinstance(kind, FLOATING):
        a = F.transform(a, lambda v: F.coalesce(v, nan().cast(kind)))
    elif validate:
        a = F.when(F.forall(a, lambda v: v.isNotNull()), a).otherwise(F.raise_error(F.lit("null values in the arrays")))
    keys = [c for c in grouped.columns if c != "__g"]
    grouped = grouped.select(*keys, F.col("__g.label").alias("label"), F.transform("__g.cells", lambda s: s["i"].cast("long")).alias("__at"), a.alias("__x"))
    x, at = F.col("__x"), F.col("__at")
    run = [base(f) in (*RUNNING, *SORTS) for f in funcs]
    if any(run):
        if not all(run):
            raise ValueError("functions that keep the rows and functions that reduce them don't mix")
        parts = [at.alias("at"), x.alias("x"), *(running(f, x, kind, fill_value).alias(f"r{k}") for k, f in enumerate(funcs))]
        tall = grouped.select(*keys, "label", F.explode(F.arrays_zip(*parts)).alias("__c"))
        return tall.select(*keys, F.col("__c.at").alias(place), F.col("__c.x").alias("cell"), "label", *(F.col(f"__c.r{k}").alias(n) for k, n in enumerate(names)))
    if not dense:
        grouped = grouped.where(F.size("__x") > 0)
    kinds = [_kind(f, kind, dtype, fill_value) for f in funcs]
    return grouped.select(row, *dims, "label", *(F.coalesce(reduced(f, x, at, kind, ddof).cast(k), _fill(fill_value, k)).alias(n) for f, k, n in zip(funcs, kinds, names, strict=True)))
