"""Group-indexed aggregation on Spark."""

from .functions.registry import NAMES, resolve
from .operators.aggregate import broadcast_aggregate, group_aggregate, unpack
from .operators.axis import axis_aggregate, cells
from .operators.index_ops import label_runs, multi_arange, prefix_sum, relabel_masked, relabel_unique, run_count, run_starts, with_previous
from .sources.tables import from_array, load
from .streaming.reductions import windowed_aggregate

__all__ = [
    "NAMES", "axis_aggregate", "broadcast_aggregate", "cells", "from_array", "group_aggregate", "label_runs", "load", "multi_arange", "prefix_sum",
    "relabel_masked", "relabel_unique", "resolve", "run_count", "run_starts", "unpack", "windowed_aggregate", "with_previous",
]
