"""SimHash near-duplicates: fingerprints of word shingles, compared exactly by tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import LOWER, table, trimmed, written
from .components import connected_components
from .tiles import Tile, linked_in_buckets

_LANES = 255  # rows that sum in lanes of eight bits


def _shingles(text: str | None, words: int, distinct: bool, seed: int) -> np.ndarray:
    """XXH64 of the word shingles of a text with A-Z lower-cased; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return np.empty(0, "<u8")
    shingles = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    return np.fromiter((xxh64_intdigest(s, seed) for s in (set(shingles) if distinct else shingles)), "<u8")


def fingerprint(text: str | None, words: int = 3, lanes: int = 1, distinct: bool = False, seed: int = 42) -> np.ndarray:
    """The SimHash of a text in lanes of 64 bits: a bit is set where over half the shingles' hashes have it.

    The first lane's hashes are the shingles' XXH64, the others' follow from these. Repeated shingles
    count each time unless distinct. A text of no words (null, empty, white space) has only zeros.
    """
    return _fingerprint(_shingles(text, words, distinct, seed), lanes)


def _fingerprint(h: np.ndarray, lanes: int) -> np.ndarray:
    """The SimHash of the shingles' hashes."""
    out = np.zeros(lanes, "<u8")
    for lane in range(lanes if len(h) else 0):
        x = h
        if lane:
            x = (h + np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        total = np.zeros(64, np.int64)
        for lo in range(0, len(x), _LANES * 256):
            bits = np.unpackbits(x[lo : lo + _LANES * 256].view(np.uint8), bitorder="little").view("<u8").reshape(-1, 8)
            for k in range(0, len(bits), _LANES):
                total += np.add.reduce(bits[k : k + _LANES], axis=0).view(np.uint8)
        out[lane] = np.packbits(total * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """`docs` without its text, with `fp`: the fingerprint's bits, a long, or binary if of several lanes."""
    keep = [c for c in docs.columns if c != text]
    source = docs.select(*keep, F.col(text).cast("string").alias("fp"))
    schema = StructType([*(docs.schema[c] for c in keep), StructField("fp", LongType() if lanes == 1 else BinaryType())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, lanes, distinct) for t in batch.column(len(keep))]
            found = pa.array(np.array(fps, "<u8").reshape(-1).view("<i8")) if lanes == 1 else pa.array([x.tobytes() for x in fps], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, "fp"])

    return source.mapInArrow(run, schema)


class Within:
    """The pairs of two tiles at `radius` differing bits or fewer. Fingerprints are the ids (one lane) or
    the payload (several).

    Blocks whose population counts differ by more than the radius are skipped; the others are compared
    by exclusive-or and bit counts. A pair that agrees in several bands is found in each of them, which
    a forest of links bears.
    """

    block = 256

    def __init__(self, radius: int) -> None:
        self.radius = radius

    def read(self, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Lanes and population counts."""
        ids, counts, payload = tile
        if payload[0] is None:
            return ids.view(np.uint64)[None], counts
        return np.frombuffer(b"".join(map(bytes, payload)), "<u8").reshape(len(payload), -1).T.copy(), counts

    def __call__(self, left: Tile, right: Tile | None) -> tuple[np.ndarray, np.ndarray]:
        (a, p_all), (b, q_all), ii, jj = self.read(left), self.read(right or left), [], []
        for x in range(0, len(a), self.block):
            for y in range(x if right is None else 0, len(b), self.block):
                p, q = p_all[x : x + self.block], q_all[y : y + self.block]
                if max(p[0], q[0]) - min(p[-1], q[-1]) > self.radius:
                    continue
                near = sum(np.bitwise_count(a[lane][x : x + self.block, None] ^ b[lane][None, y : y + self.block]).astype(np.int16) for lane in range(len(a))) <= self.radius
                i, j = np.nonzero(np.triu(near, 1) if right is None and x == y else near)
                ii.append(i + x)
                jj.append(j + y)
        return np.concatenate(ii or [np.empty(0, int)]), np.concatenate(jj or [np.empty(0, int)])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp long, component): the smallest id reachable by fingerprints at `radius` bits or fewer.

    The whole grid of tile pairs grows with the square of the rows, so tiles are formed within bands:
    of radius + 1 bands of bits, two fingerprints within the radius agree in one (pigeonhole), which
    loses no pair. Equal fingerprints are one node. Rows with null ids take part; a component of such
    rows alone is null. Repeated rows get equal results; an empty table gives none.
    """
    fps = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), words=words), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    bands = radius + 1
    edges = [64 * k // bands for k in range(bands + 1)]
    keys = [F.lit(k << 32) + F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    rows = nodes.select(F.explode(F.array(*keys)).alias("bucket"), F.bit_count("fp").cast("int").alias("ord"), F.col("fp").alias("id"), F.lit(None).cast("binary").alias("payload"))
    return _grouped(fps, nodes.withColumn("node", F.col("fp")), linked_in_buckets(rows, Within(radius), "simhash"))


def _grouped(fps: DataFrame, nodes: DataFrame, links: DataFrame, key: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(id, fp, component) from rows (id, *key), nodes (node, *key, least) and links between nodes."""
    named = connected_components(links.select("a", F.col("b"))).join(nodes.select("node", "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("group_id"))
    linked = written(named.join(least, "component").select("node", "group_id"), "linked")
    known = nodes.join(linked, "node", "left").select(*key, F.coalesce("group_id", "least").alias("component"))
    return fps.join(known, list(key)).select("id", "fp", "component")


#: Lanes of the wide fingerprints, and the share of pairs just at the similarity that may share no bucket.
WIDE, MISSED, PER_BUCKET = 8, 0.001, 64
#: Texts of at most so many distinct shingles meet by shared shingles, for bits of so few say little.
SMALL = 100
#: Rows of a tile of shingle sets.
SETS = 256


def _share(own: int, other: int, both: int) -> float:
    """The share of bits that differ between sets of own + both and other + both shingles."""
    p = [np.array([math.comb(n, k) / 2**n for k in range(n + 1)]) for n in (own, other, both)]
    out = 0.0
    for k in range(both + 1):
        a, b = (p[s][2 * (np.arange(n + 1) + k) > n + both].sum() for s, n in ((0, own), (1, other)))
        out += p[2][k] * (a * (1 - b) + b * (1 - a))
    return out


def radius_of(similarity: float, lanes: int = WIDE) -> int:
    """Differing bits that two texts of this Jaccard similarity have at most, with four standard deviations.

    Large sets of similarity j have a cosine of at least 2j / (1 + j), and a bit differs with the share of
    their angle; in sets of a few shingles, counted out here, ties make it more.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    few = [(a, x - a, c) for c in range(1, 25) for x in range(1, math.floor(c * (1 / similarity - 1) + 1e-9) + 1) for a in range((x + 1) // 2, x + 1)]
    share = max(share, *(_share(*sizes) for sizes in few)) if few else share
    return math.floor(64 * lanes * share + 4 * math.sqrt(64 * lanes * share * (1 - share)))


def prefix(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the least hashes of a sorted set that sets of the similarity or more have one in common."""
    return shingles[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]


class Alike:
    """Pairs of two tiles of shingle sets (payload: fingerprint, then sorted hashes) of the Jaccard similarity
    or more, as many as connect what all such pairs connect.

    Only pairs whose sizes and fingerprints allow it are counted. A breadth-first walk compares each set with
    those not reached yet, so a group of copies costs about one comparison a set. Tiles are in the order of
    1000 times the logarithm of the size, and those that differ by more than `radius` in it hold no pair.
    """

    def __init__(self, similarity: float) -> None:
        self.similarity, self.bits = similarity, radius_of(similarity)
        self.radius = math.ceil(-1000 * math.log(similarity)) + 1

    def __call__(self, left: Tile, right: Tile | None) -> tuple[np.ndarray, np.ndarray]:
        payload = [*left[2], *(right[2] if right else [])]
        fps = np.array([np.frombuffer(p, "<u8", WIDE) for p in payload])
        sets = [np.frombuffer(p, "<u8", offset=8 * WIDE) for p in payload]
        size, n = np.array([len(s) for s in sets]), len(left[0])
        unseen, ii, jj = np.ones(len(sets), bool), [], []
        for start in range(n):
            queue = [start] if unseen[start] else []
            unseen[start] = False
            for u in queue:
                lo, hi = (0, len(sets)) if right is None else (n, len(sets)) if u < n else (0, n)
                at = lo + np.flatnonzero(unseen[lo:hi])
                least, most = np.minimum(size[at], size[u]), np.maximum(size[at], size[u])
                at = at[(least > 0) & (least >= self.similarity * most - 1e-6)]
                at = at[np.bitwise_count(fps[at] ^ fps[u]).sum(axis=1, dtype=np.int32) <= self.bits]
                if not len(at):
                    continue
                found = np.concatenate([sets[v] for v in at])
                place = np.minimum(np.searchsorted(sets[u], found), size[u] - 1)
                both = np.add.reduceat((sets[u][place] == found).astype(np.int64), np.r_[0, np.cumsum(size[at])[:-1]])
                at = at[both / (size[at] + size[u] - both) >= self.similarity]
                unseen[at] = False
                queue.extend(at.tolist())
                ii.extend(np.minimum(at, u).tolist())
                jj.extend(np.maximum(at, u).tolist())
        return np.array(ii, int), np.array(jj, int) - (0 if right is None else n)


def _wide(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, fp, digest, size, prefix, shingles) of rows (id, text): fp and digest stand for the set of distinct
    shingles, `shingles` are their hashes, sorted, and `prefix` those of small sets that others are met by."""
    most = SMALL / similarity  # a small set is similar to none of more

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(1):
                h = np.sort(_shingles(t.as_py(), words, True, 42))
                first = prefix(h, similarity).tobytes() if 0 < len(h) <= most else None
                rows.append((_fingerprint(h, WIDE).tobytes(), int(h.sum(dtype="<u8").view("<i8")), len(h), first, h.tobytes()))
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "fp", "digest", "size", "prefix", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("string")).mapInArrow(run, f"id {kind}, fp binary, digest long, size int, prefix binary, shingles binary")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, fp binary, component): groups of texts whose distinct shingles have the Jaccard similarity or more.

    Candidates are found by fingerprints, links are decided by the shingles. Radii of a few bits miss most
    such pairs, as these differ in about a seventh of the bits. So fingerprints are wide, and tiles are formed
    within buckets of sampled bits, as many tables of as many bits as the number of fingerprints asks for
    (see `plan`), and for small sets within those that share a shingle of their prefixes, which loses no pair;
    all of a bucket are compared by exclusive-or and bit counts. Then the sets of each component of candidates are
    compared, in tiles again, and what is linked there makes the groups. Nulls, repeats and empty tables are as in
    `near_duplicates`.
    """
    from .embedding_dedup import plan

    wide = written(_wide(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), words, similarity), "wide")
    nodes = written(wide.groupBy("fp", "digest", "size", "prefix").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    bits, tables = plan(nodes.where(f"size > {SMALL}").count(), 2 * similarity / (1 + similarity), MISSED, PER_BUCKET)
    places = np.array([np.random.default_rng([11, t]).choice(64 * WIDE, bits, replace=False) for t in range(tables)])

    @trimmed
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                batch = whole.iloc[lo : lo + 1000]
                all_bits = np.unpackbits(np.frombuffer(b"".join(batch.fp), np.uint8).reshape(len(batch), -1), axis=1, bitorder="little")
                ones = all_bits.sum(axis=1, dtype=np.int32)
                node, fp, size = batch.node.to_numpy(), batch.fp.to_numpy(), batch["size"].to_numpy()
                large = np.flatnonzero(size > SMALL)
                for t, at in enumerate(places if len(large) else ()):
                    yield pd.DataFrame({"bucket": all_bits[large][:, at].astype(np.int64) @ (1 << np.arange(bits)) | t << 32, "ord": ones[large], "id": node[large], "payload": fp[large]})
                keys = [np.frombuffer(p or b"", "<i8") for p in batch.prefix]
                small = np.repeat(np.arange(len(batch)), [len(k) for k in keys])
                if len(small):
                    yield pd.DataFrame({"bucket": np.concatenate(keys), "ord": ones[small], "id": node[small], "payload": fp[small]})

    rows = nodes.select("node", "fp", "size", "prefix").mapInPandas(deal, "bucket long, ord int, id long, payload binary")
    near = linked_in_buckets(rows, Within(radius_of(similarity)), "near")
    parts = connected_components(near.select("a", "b")).join(nodes.select("node", "fp", "digest"), "node")
    sets = wide.select("fp", "digest", "size", "shingles").join(parts, ["fp", "digest"]).dropDuplicates(["node"])
    order = F.round(1000 * F.log(F.greatest("size", F.lit(1)))).cast("int")
    found = linked_in_buckets(sets.select(F.col("component").alias("bucket"), order.alias("ord"), F.col("node").alias("id"), F.concat("fp", "shingles").alias("payload")), Alike(similarity), "alike", tile=SETS)
    return _grouped(wide.select("id", "fp", "digest"), nodes, found, ("fp", "digest"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with the row of the smallest id of each group of near copies; rows with null ids stay."""
    keep = near_copies(docs, id_col, text, words, similarity).where("id = component or id is null").select(F.col("id").alias("__id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
