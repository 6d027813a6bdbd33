"""Comparison of all pairs within buckets, by tiles of bounded size.

Rows are range-partitioned and sorted by bucket and order, so a bucket of any size is spread over
tasks. Consecutive rows of a bucket make tiles of at most TILE rows; a tile is compared with itself
where it is built, and the tiles of a bucket that has several are paired by a join of whole tiles. No
task holds more than two tiles, and what a comparison returns is linear in its tiles: links to a root
(a spanning forest) and counts of links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, written

TILE = 1024
OUT = "a long, b long, n long"
_TILES = OUT + ", bucket long, tile string, low int, high int, ids binary, payload binary"

#: (ids, order, payload) of two tiles, or of one and None -> (i, j) of the linked pairs.
Tile = tuple[np.ndarray, np.ndarray, list]
Compare = Callable[[Tile, Tile | None], tuple[np.ndarray, np.ndarray]]


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For 0..n-1, the smallest index reachable by the links (i, j)."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[i], root[j])
        if (m == root[i]).all() and (m == root[j]).all():
            return root
        for at in (i, j, root[i], root[j]):
            np.minimum.at(root, at, m)
        while (root != root[root]).any():
            root = root[root]


def _linked(ids: np.ndarray, weights: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """The spanning forest of the links as rows (a, b, 0), and with weights the links of each id as (a, null, n)."""
    root = roots(i, j, len(ids))
    own = np.flatnonzero(root != np.arange(len(ids)))
    out = [pd.DataFrame({"a": ids[own], "b": pd.array(ids[root[own]], dtype="Int64"), "n": 0})]
    if weights is not None and len(i):
        n = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
        at = np.flatnonzero(n)
        out.append(pd.DataFrame({"a": ids[at], "b": pd.array([pd.NA] * len(at), dtype="Int64"), "n": n[at].astype("int64")}))
    return pd.concat(out)


def linked_in_buckets(rows: DataFrame, compare: Compare, label: str, weigh: Callable[[list], np.ndarray] | None = None, tile: int = TILE) -> DataFrame:
    """Links within the buckets of `rows` (bucket long, ord int, id long, payload binary).

    compare gives the linked index pairs of a tile, or between two. Returns rows (a, b, n): links of a
    spanning forest have b, counts of links (with `weigh`, each link counted as the other's weight)
    have n. `tile` is the most rows of a tile. Null, empty and repeated buckets are all alike to it; no rows give none.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        at, held, first, spread = None, [], True, False

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            """Compares what is held; gives it out as a tile where its bucket may have more tiles."""
            rows = pd.concat(held) if len(held) > 1 else held[0]
            ids, order, payload = rows.id.to_numpy(), rows.ord.to_numpy(), rows.payload.tolist()
            if len(ids) > 1:
                i, j = compare((ids, order, payload), None)
                if len(i):
                    yield _linked(ids, weigh and weigh(payload), i, j)
            if first or last or spread:
                import pickle

                yield pd.DataFrame({"a": [0], "b": pd.array([pd.NA], dtype="Int64"), "n": [0], "bucket": [at], "tile": [uuid4().hex], "low": [int(order.min())], "high": [int(order.max())], "ids": [ids.astype("<i8").tobytes()], "payload": [pickle.dumps((order, payload))]})

        for batch in batches:
            buckets = batch.bucket.to_numpy()
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(buckets)], strict=True):
                if hi == lo:
                    continue
                if at is not None and buckets[lo] != at:
                    if sum(map(len, held)) > 1 or first or spread:
                        yield from flush(False)
                    held, first, spread = [], False, False
                at = buckets[lo]
                while lo < hi:
                    room = tile - sum(map(len, held))
                    if room <= 0:
                        spread = True
                        yield from flush(False)
                        held, room = [], tile
                    held.append(batch.iloc[lo : min(hi, lo + room)])
                    lo += room
        if held:
            yield from flush(True)

    columns = [x.split()[0] for x in _TILES.split(", ")]

    @trimmed
    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in build(batches):
            yield out.reindex(columns=columns).astype({"low": "Int32", "high": "Int32", "bucket": "Int64", "tile": object, "ids": object, "payload": object})

    @trimmed
    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        for batch in batches:
            for row in batch.itertuples(index=False):
                left, right = ((np.frombuffer(ids, "<i8"), *pickle.loads(payload)) for ids, payload in ((row.ids, row.payload), (row.ids2, row.payload2)))
                i, j = compare(left, right)
                if len(i):
                    yield _linked(np.concatenate([left[0], right[0]]), weigh and np.concatenate([weigh(left[2]), weigh(right[2])]), i, j + len(left[0]))

    spark = rows.sparkSession
    ordered = rows.repartitionByRange("bucket", "ord", "id").sortWithinPartitions("bucket", "ord", "id")
    out = written(ordered.mapInPandas(built, _TILES), label)
    tiles = out.where("tile is not null").select("bucket", "tile", "low", "high", "ids", "payload")
    other = tiles.select("bucket", *(F.col(c).alias(f"{c}2") for c in tiles.columns[1:]))
    pairs = tiles.join(other, "bucket").where("tile < tile2")
    if radius := getattr(compare, "radius", None):  # tiles too far apart in the order hold no link
        pairs = pairs.where(F.greatest("low", "low2") - F.least("high", "high2") <= radius)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crossed = pairs.select("ids", "payload", "ids2", "payload2").repartition(parts).mapInPandas(cross, OUT)
    return written(out.where("tile is null").select("a", "b", "n").union(crossed), label)
