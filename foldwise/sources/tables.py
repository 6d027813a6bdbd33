"""Thin loaders; Parquet scans prune columns and take pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def from_array(spark: SparkSession, labels, values=None, label: str = "g", value: str = "a", pos: str = "p") -> DataFrame:
    """A DataFrame of in-memory vectors: labels (one vector, or several as g0, g1, ..), values and positions.

    ValueError if they differ in length.
    """
    import numpy as np
    import pandas as pd

    labels = np.asarray(labels)
    rows = {f"{label}{k}": x for k, x in enumerate(labels)} if labels.ndim == 2 else {label: labels}
    n = labels.shape[-1]
    if values is not None:
        if len(values) != n:
            raise ValueError(f"{n} labels, but {len(values)} values")
        rows[value] = np.asarray(values)
    frame = pd.DataFrame(rows | {pos: np.arange(n)})
    unsigned = {c: "int64" for c, t in frame.dtypes.items() if t.kind == "u"}
    return spark.createDataFrame(frame.astype(unsigned)).withColumn(pos, F.col(pos).cast("long"))
