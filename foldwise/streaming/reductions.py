"""Reductions over streams: those of no row order are mergeable, and so run in windows with watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import REDUCE, Values, reduction
from ..functions.registry import NEEDS_POS, resolve
from ..functions.typing import base


def windowed_aggregate(stream: DataFrame, by: str, value: str, funcs: Sequence[str], *, time: str, window: str, slide: str | None = None, late: str = "0 seconds", ddof: int = 0) -> DataFrame:
    """(window_start, window_end, by, one column per function); rows later than `late` are dropped.

    Works on batches alike. Labels not met are not filled: a stream's label space is open.
    """
    names = [resolve(f) for f in funcs]
    for f in names:
        if callable(f) or f in NEEDS_POS or base(f) not in REDUCE:
            raise ValueError(f"{f} needs the rows' order, which a stream doesn't have")
    kind = stream.schema[value].dataType
    columns = [reduction(f, Values(F.col(value), None, kind, ddof, f.startswith("nan"))).alias(f) for f in names]
    span = F.window(time, window, slide) if slide else F.window(time, window)
    got = stream.withWatermark(time, late).groupBy(span.alias("w"), by).agg(*columns)
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, *names)
