"""Sizes of label spaces, their checks, and dense results, all within the plan."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that one row makes when a grid is made from rows.
BLOCK = 1 << 16
INT_MAX = 2**31 - 1


def declared(by: list[str], size: int | Sequence[int] | None) -> list[int] | None:
    """The sizes given, one for each label column."""
    sizes = None if size is None else [size] if isinstance(size, int) else list(size)
    if sizes is not None and len(sizes) != len(by):
        raise ValueError(f"{len(by)} label columns, but a size of {len(sizes)}")
    return sizes


def check_now(df: DataFrame, by: list[str], sizes: list[int] | None, value: str | None) -> None:
    """ValueErrors of a job of its own: null, negative or too large labels, null values, no rows and no size."""
    checks = [f(c).alias(f"{n}{k}") for k, c in enumerate(by) for n, f in (("low", F.min), ("high", F.max), ("null", lambda c: F.count_if(F.col(c).isNull())))]
    checks.append((F.count_if(F.col(value).isNull()) if value else F.lit(0)).alias("values"))
    row = df.agg(*checks).first()
    for k, c in enumerate(by):
        low, high = row[f"low{k}"], row[f"high{k}"]
        if row[f"null{k}"]:
            raise ValueError(f"null labels in {c}")
        if low is not None and low < 0:
            raise ValueError(f"negative labels in {c}")
        if sizes is not None and high is not None and high >= sizes[k]:
            raise ValueError(f"labels in {c} reach {high}, beyond the size {sizes[k]}")
        if sizes is None and high is None:
            raise ValueError("no rows: give the size")
    if row["values"]:
        raise ValueError(f"null values in {value}")


def checked_label(c: str, size: int | None) -> Column:
    """The label, or an error when the plan runs and meets a null, negative or too large one."""
    label = F.col(c)
    wrong = F.when(label.isNull(), F.lit(f"null labels in {c}")).when(label < 0, F.lit(f"negative labels in {c}"))
    valid = label >= 0
    if size is not None:
        wrong = wrong.otherwise(F.concat(F.lit(f"labels in {c} reach "), label.cast("string"), F.lit(f", beyond the size {size}")))
        valid = valid & (label < size)
    return F.when(valid, label).otherwise(F.raise_error(wrong)).alias(c)


def checked_value(c: str) -> Column:
    return F.coalesce(F.col(c), F.raise_error(F.lit(f"null values in {c}")))


def whole(got: DataFrame) -> DataFrame:
    """`got` for a second use: a filter that always holds, yet reads every column, keeps the planner from pruning it
    into another aggregate, so both uses read one shuffle."""
    return got.where(F.hash(*got.columns) <= INT_MAX)


def inferred(source: DataFrame, by: list[str], validate: bool) -> DataFrame:
    """One row with the columns __size0, ..: the greatest labels plus one."""
    high = [F.max(c).cast("long") + 1 for c in by]
    none = F.raise_error(F.lit("no rows: give the size")).cast("long") if validate else F.lit(0)
    return source.agg(*(F.coalesce(h, none).alias(f"__size{k}") for k, h in enumerate(high)))


def _stride(k: int, sizes: list[str], order: str) -> str:
    return " * ".join(["1L", *(sizes[k + 1 :] if order == "C" else sizes[:k])])


def place(by: list[str], sizes: list[str], order: str) -> Column:
    """The place of a label combination in an array of that shape; sizes are numbers or columns, as SQL."""
    return F.expr(" + ".join(f"`{c}` * ({_stride(k, sizes, order)})" for k, c in enumerate(by)))


def grid(rows: DataFrame, kept: list[str], by: list[str], sizes: list[str], order: str, spread: bool) -> DataFrame:
    """For each of `rows` all label combinations with their place in an array of that shape, made block by block;
    `spread` shares the blocks of a single row out to tasks."""
    if order not in ("C", "F"):
        raise ValueError("order is C or F")
    cells = " * ".join(["1L", *sizes])
    # A space of no cells has no block: sequence(0, -1) would count downwards.
    blocks = rows.where(F.expr(f"{cells} > 0")).withColumn("__block", F.explode(F.expr(f"sequence(0L, ({cells} - 1) div {BLOCK}L)")))
    if spread:
        blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__block")
    filled = blocks.withColumn("index", F.explode(F.expr(f"sequence(__block * {BLOCK}L, least({cells}, (__block + 1) * {BLOCK}L) - 1)")))
    return filled.select(*kept, "index", *_labels(by, sizes, order))


def _labels(by: list[str], sizes: list[str], order: str) -> list[Column]:
    return [F.expr(f"(index div ({_stride(k, sizes, order)})) % {sizes[k]}").cast("long").alias(c) for k, c in enumerate(by)]


def densified(got: DataFrame, by: list[str], over: list[str], sizes: list[int] | None, order: str, high: DataFrame | None) -> DataFrame:
    """`got` with a row for every label combination; further keys `over` each get the whole grid, whose
    rows are the result itself. Sizes not declared are those of `high`."""
    spark = got.sparkSession
    if sizes is None:
        names = [f"__size{k}" for k in range(len(by))]
        rows = whole(got).select(*over).distinct().withColumns({n: high.select(n).scalar() for n in names}) if over else high
        full = grid(rows, over, by, names, order, not over)
    elif over:
        full = grid(whole(got).select(*over).distinct(), over, by, [f"{s}L" for s in sizes], order, False)
    else:
        if order not in ("C", "F"):
            raise ValueError("order is C or F")
        full = spark.range(prod(sizes)).select(F.col("id").alias("index")).select("index", *_labels(by, [f"{s}L" for s in sizes], order))
    left, right = full.alias("__l"), got.alias("__r")
    met = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in over] + [F.col(f"__l.{c}") == F.col(f"__r.{c}") for c in by]
    on = met[0]
    for m in met[1:]:
        on = on & m
    kept = [c for c in got.columns if c not in (*by, *over)]
    return left.join(right, on, "left").select("__l.index", *(F.col(f"__l.{k}").alias(k) for k in (*over, *by)), *(F.col(f"__r.{c}").alias(c) for c in kept))
