"""Utilities on labels and runs. Rows are ordered by a position column of whole numbers.

What runs over all rows in order is done in blocks of consecutive positions: each block is summed up, the
few blocks get their offsets, and rows add theirs. No window gathers all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _blocks(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(pos) / block))


def prefix_sum(df: DataFrame, pos: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """`df` with the sum of `value` over all rows up to each."""
    rows = _blocks(df.withColumn("__value", value), pos, block)
    totals = rows.groupBy("__block").agg(F.sum("__value").alias("__total"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    offsets = totals.select("__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__sum", F.sum("__value").over(inside)).join(offsets, "__block")
    return summed.withColumn(out, F.col("__sum") + F.col("__offset")).drop("__block", "__value", "__sum", "__offset")


def with_previous(df: DataFrame, pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """`df` with the value of the row before, null in the first."""
    rows = _blocks(df, pos, block)
    lasts = rows.groupBy("__block").agg(F.max_by(value, pos).alias("__last"))
    carried = lasts.select("__block", F.lag("__last").over(Window.orderBy("__block")).alias("__carried"))  # a row per block
    inside = Window.partitionBy("__block").orderBy(pos)
    first = F.row_number().over(inside) == 1
    return rows.withColumns({"__lag": F.lag(value).over(inside), "__first": first}).join(carried, "__block").withColumn(out, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__lag"))).drop("__block", "__last", "__carried", "__lag", "__first")


def multi_arange(df: DataFrame, pos: str, count: str) -> DataFrame:
    """(pos, value): 0..n-1 for each row of count n, in order of (pos, value); rows of 0 or less have none."""
    many = df.where(F.col(count) > 0)
    return many.select(pos, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)).alias("value"))


def label_runs(df: DataFrame, pos: str, value: str, out: str = "label", block: int = BLOCK) -> DataFrame:
    """Numbers the runs of equal values other than zero (or of true) 1, 2, ..; zeros are 0."""
    rows = df.withColumn("__x", F.col(value).cast("long"))
    rows = with_previous(rows, pos, "__x", "__before", block)
    on = F.coalesce(F.col("__x"), F.lit(0)) != 0
    starts = (on & ~F.col("__x").eqNullSafe(F.col("__before"))).cast("long")
    numbered = prefix_sum(rows, pos, starts, "__run", block)
    return numbered.withColumn(out, F.when(on, F.col("__run")).otherwise(0)).drop("__x", "__before", "__run")


def relabel_unique(df: DataFrame, label: str, out: str = "relabelled") -> DataFrame:
    """Labels numbered without gaps, in order; 0 stays 0, met or not."""
    zero = df.sparkSession.range(1).select(F.col("id").cast("long").alias(label))
    known = df.select(F.col(label).cast("long").alias(label)).distinct().union(zero).distinct()
    ranks = known.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long").alias(out))
    return df.join(ranks, label)


def relabel_masked(df: DataFrame, label: str, mask: DataFrame, keep: str, out: str = "relabelled") -> DataFrame:
    """Labels that `mask` (label, keep) keeps, numbered without gaps; the others, and 0, are 0."""
    kept = mask.where(F.col(keep) & (F.col(label) != 0)).select(label).distinct()
    ranks = kept.select(label, F.row_number().over(Window.orderBy(label)).cast("long").alias(out))
    return df.join(ranks, label, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def run_starts(df: DataFrame, pos: str, label: str, block: int = BLOCK) -> DataFrame:
    """(start): positions where a run of equal labels begins, and one past the last row."""
    rows = with_previous(df.select(pos, label), pos, label, "__before", block).withColumn("__new", ~F.col(label).eqNullSafe(F.col("__before")))
    first = df.agg(F.min(pos).alias("__min"), (F.max(pos) + 1).alias("start"))
    starts = rows.where(F.col("__new")).select(F.col(pos).alias("start")).union(first.select(F.col("__min")))
    return starts.union(first.select("start")).where("start is not null").distinct()


def run_count(df: DataFrame, pos: str, label: str, block: int = BLOCK) -> DataFrame:
    """(runs): how many runs of equal labels there are."""
    return run_starts(df, pos, label, block).agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("runs"))
