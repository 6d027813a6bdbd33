"""Embedding near-duplicates: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, written
from .components import connected_components
from .tiles import Tile, linked_in_buckets

#: Vectors that a bucket holds on average, and the share of pairs at the threshold that may be missed.
PER_BUCKET, MISSED = 200, 1e-4


def plan(n: int, threshold: float, missed: float = MISSED, per_bucket: int = PER_BUCKET) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors: keys of more bits as n grows, and so many
    tables that a pair exactly at the threshold shares no bucket with probability `missed`."""
    bits = max(4, min(24, round(math.log2(max(n, 1) / per_bucket)) if n else 4))
    hit = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log1p(-hit))) if hit < 1 else 1


class Cosine:
    """Pairs at the threshold or above, each in the first table whose key its vectors share."""

    def __init__(self, threshold: float, tables: int) -> None:
        self.threshold, self.tables = threshold, tables

    def read(self, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([np.frombuffer(p, "<u4", self.tables, 12) for p in tile[2]])
        x = np.array([np.frombuffer(p, "<f8", offset=12 + 4 * self.tables) for p in tile[2]])
        return keys, x

    def __call__(self, left: Tile, right: Tile | None) -> tuple[np.ndarray, np.ndarray]:
        (ka, a), (kb, b) = self.read(left), self.read(right or left)
        near = a @ b.T >= self.threshold
        i, j = np.nonzero(np.triu(near, 1) if right is None else near)
        (here,) = {int.from_bytes(p[8:12], "little") for p in left[2]}
        first = np.argmax(ka[i] == kb[j], axis=1) == here
        return i[first], j[first]


def weights(payload: list) -> np.ndarray:
    return np.array([int.from_bytes(p[:8], "little") for p in payload], float)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, seed: int = 7) -> DataFrame:
    """(id, n_links long, component): other vectors linked directly, and the smallest id reachable.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal
    vectors are one class, compared once and counted as often as they occur. Vectors of different
    lengths never meet. Every pair that shares a bucket in one of the tables is verified by its cosine in
    double precision. An empty table gives none; null ids take part but name no component.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    big = F.array_max(F.transform("x", F.abs))
    valid = F.coalesce((F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & (big > 0), F.lit(False))
    unit = rows.where(valid).withColumn("x", F.transform("x", lambda v: v / big)).withColumn("x", F.transform("x", lambda v: v / norm))
    unit = written(unit, "unit")
    classes = written(unit.groupBy("x").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(classes.count(), threshold)
    compare = Cosine(threshold, tables)

    @trimmed
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.iloc[lo : lo + 500]
                for dim, part in batch.groupby(batch.x.map(len)):
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                    x = np.array(part.x.tolist(), "<f8")
                    keys = ((x @ planes[dim] >= 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits))).astype("<u4")
                    for t in range(tables):
                        yield pd.DataFrame({
                            "bucket": (keys[:, t].astype("i8") | t << 24 | (dim % (1 << 20)) << 40), "ord": np.int32(0), "id": part.cid.to_numpy(),
                            "payload": [int(n).to_bytes(8, "little") + t.to_bytes(4, "little") + k.tobytes() + v.tobytes() for n, k, v in zip(part.n, keys, x, strict=True)],
                        })

    dealt = classes.select("cid", "n", "x").mapInPandas(deal, "bucket long, ord int, id long, payload binary")
    links = linked_in_buckets(dealt, compare, "cosine", weights)
    counts = links.groupBy("a").agg(F.sum("n").alias("links"))
    parts = connected_components(links.where("b is not null").select("a", "b"))
    named = parts.join(classes.select("cid", "least"), F.col("node") == F.col("cid"))
    least = named.groupBy("component").agg(F.min("least").alias("group_id"))
    linked = named.join(least, "component").select("cid", "group_id")
    known = classes.join(linked, "cid", "left").join(counts, F.col("cid") == F.col("a"), "left")
    known = known.select("x", F.coalesce("group_id", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    found = unit.join(known, "x").select("id", "n_links", "component")
    return found.union(rows.where(~valid).select("id", F.lit(0).cast("long"), "id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
