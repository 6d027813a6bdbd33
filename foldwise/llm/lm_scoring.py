"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

The model interpolates bigrams with unigrams by absolute discounting. The filter is a table of segments;
a context's segment follows from its hash, and holds the context's count, its number of different
followers and its bigrams' counts. An item of quantised count q is inserted once for each level 1..q, so
that probing level after level until one is missing reads q. The segments are sized by their items, so
the filter grows with the corpus at one error rate.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from .common import LOWER, table, trimmed, written
from .language_id import id_remainder

#: Base of the count levels; bits set per item, all in one block of 64, and bits per item (about 3 % false
#: positives).
BASE, PROBES, BITS = 1.5, 4, 8
#: Bytes of the filter that are broadcast at once; a larger filter is read in as many passes over the texts.
PASS_BYTES = 128 << 20
#: Words whose exact counts are broadcast: the most frequent, at most so many. Counts of others are joined.
COMMON_WORDS = 150_000
#: Distinct bigrams gathered before a worker sends them on, and meant for a segment.
GATHERED, PER_SEGMENT = 1 << 20, 1 << 19
END = b""  # no word is empty
_EMPTY = np.uint64(0)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end."""
    return [*(text or "").encode("utf-8", "replace").translate(LOWER).split(), END]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _powers:
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(_BYTES, p, np.uint64)]) for p in (np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each token: a polynomial of its bytes, found from running sums, then mixed."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    if len(tokens) > 1 and lengths.sum() > _BYTES:
        half = len(tokens) // 2
        return np.concatenate([hashes(tokens[:half]), hashes(tokens[half:])])
    if lengths.sum() > _BYTES:  # one token, too long for the tables
        from xxhash import xxh64_intdigest

        return np.array([xxh64_intdigest(tokens[0])], np.uint64)
    data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint64) + np.uint64(1)
    power, inverse = _tables()
    run = np.r_[_EMPTY, np.cumsum(data * power[: len(data)], dtype=np.uint64)]
    end = np.cumsum(lengths)
    start = end - lengths
    return _mix((run[end] - run[start]) * inverse[start] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def keys(h: np.ndarray) -> np.ndarray:
    """Context keys: 40 bits of the hash. A bigram's key is its context's and 24 bits of the word's hash."""
    return h >> np.uint64(24)


def bigrams(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return keys(before) << np.uint64(24) | h & np.uint64(0xFFFFFF)


class Indexed:
    """Words of several texts as numbers: the distinct words, and for each token its word's number, its
    text's number and the number of the word before (the end, at a text's beginning)."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__  # a new word's number is how many there are before it
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.fromiter(map(number.__getitem__, chain([END], *texts)), np.int64, int(self.n.sum()) + 1)[1:]
        number.default_factory = None  # else the dictionary holds itself, and its words stay
        self.words = list(number)
        self.start = np.cumsum(self.n) - self.n
        self.before = np.r_[0, self.at[:-1]]
        self.before[self.start] = 0
        self.hash = hashes(self.words)


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 for 0, else 1 + floor(log_BASE(count))."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the whole counts that share a level."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** levels.astype(float) - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0)


CONTEXT, TYPES, PAIR = (np.uint64(k) for k in (0x1111111111111111, 0x2222222222222222, 0x4444444444444444))


def places(key: np.ndarray, kind: np.uint64, at_level: np.ndarray | int, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The block of an item at a level, and the bits that it has there."""
    x = _mix(_mix(key ^ kind) + np.asarray(at_level, np.uint64) * np.uint64(_P))
    mask = np.zeros(len(x), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << (x >> np.uint64(6 * k) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.asarray(blocks, np.uint64) >> np.uint64(32)).astype(np.int64), mask


def segment(contexts: np.ndarray, counts: np.ndarray, types: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> bytes:
    """The bits of a segment."""
    groups = [(key, kind, level(n)) for key, kind, n in ((contexts, CONTEXT, counts), (contexts, TYPES, types), (pairs, PAIR, pair_counts))]
    blocks = max(1, math.ceil(sum(int(n.sum()) for *_, n in groups) * BITS / 64))
    bits = np.zeros(blocks, np.uint64)
    for key, kind, n in groups:
        for at_level in range(1, int(n.max(initial=0)) + 1):
            block, mask = places(key[n >= at_level], kind, at_level, blocks)
            np.bitwise_or.at(bits, block, mask)
    return bits.tobytes()


@dataclass
class Filter:
    """Segments low..high of the filter."""

    low: int
    high: int
    shift: int  # of a context key, to its segment
    bits: np.ndarray  # blocks of all segments, end to end
    at: np.ndarray  # first block of each
    size: np.ndarray  # blocks of each

    def levels(self, key: np.ndarray, context: np.ndarray, kind: np.uint64) -> np.ndarray:
        """The quantised count of each item whose segment is here, by probes level after level; else 0."""
        out = np.zeros(len(key), np.uint8)
        seg = (context >> np.uint64(self.shift)).astype(np.int64)
        left = np.flatnonzero((seg >= self.low) & (seg < self.high))
        seg = seg[left] - self.low
        at, size = self.at[seg], self.size[seg]
        n = 0
        while len(left):
            n += 1
            block, mask = places(key[left], kind, n, size)
            hit = self.bits[at + block] & mask == mask
            left, at, size = left[hit], at[hit], size[hit]
            out[left] = n
        return out


@dataclass
class Totals:
    tokens: int  # N
    distinct: int  # V
    discount: float


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Runs of a batch's rows with their words, of about a million bytes; only a run's texts are made strings."""
    from pyarrow import compute

    from .words import runs

    texts = batch.column(column)
    for lo, hi in runs(compute.fill_null(compute.binary_length(texts), 0).to_pylist()):
        yield lo, hi, [words(t) for t in texts[lo:hi].to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long of training texts, every long of all) of documents (text, train)."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for counter, at in ((train, 1), (other, 2)):
                known = list(counter.items())
                counter.clear()
                for lo in range(0, len(known), 1 << 16):
                    part = known[lo : lo + (1 << 16)]
                    n = [pa.array([k for _, k in part], pa.int64()), pa.array(np.zeros(len(part), np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), n[at == 2], n[at == 1]], names=["word", "c", "other"])

        for batch in batches:
            for lo, hi, texts in _batches(batch, 0):
                for ws, learn in zip(texts, batch.column(1)[lo:hi].to_pylist(), strict=True):
                    (train if learn else other).update(ws)
                if len(train) + len(other) > 1 << 18:
                    yield from out()
        yield from out()

    parts = docs.select("text", "train").mapInArrow(count, "word binary, c long, other long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum(F.col("c") + F.col("other")).alias("every"))


def filter_segments(docs: DataFrame, segments: int) -> DataFrame:
    """(segment int, bits binary, ones long, twos long) from the training texts.

    Each worker sends, per segment, its distinct bigrams sorted and their counts, compressed; a segment's
    parts are merged in one task. Segments are as many as keep one near PER_SEGMENT bigrams, so a very
    frequent context makes its segment larger only by its different followers.
    """
    shift = 40 - (segments.bit_length() - 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pd.DataFrame]:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            seg = (pair >> np.uint64(24 + shift)).astype(np.int64)
            cut = np.r_[0, np.flatnonzero(np.diff(seg)) + 1, len(seg)]
            press = ZstdCompressor(level=1)
            blobs = []
            for lo, hi in zip(cut, cut[1:], strict=False):
                steps = np.diff(pair[lo:hi], prepend=_EMPTY).view(np.uint8).reshape(-1, 8).T.copy()
                blobs.append(press.compress(np.concatenate([steps.ravel(), np.minimum(n[lo:hi], 255).astype(np.uint8), n[lo:hi][n[lo:hi] > 254].astype("<i8").view(np.uint8)]).tobytes()))
            yield pd.DataFrame({"segment": seg[cut[:-1]].astype(np.int32), "n": np.diff(cut), "blob": blobs})

        for batch in batches:
            for lo, hi, texts in _batches(batch, 0):
                texts = [ws for ws, learn in zip(texts, batch.column(1)[lo:hi].to_pylist(), strict=True) if learn]
                if texts:
                    x = Indexed(texts)
                    held.append(bigrams(x.hash[x.at], x.hash[x.before]))
                if sum(map(len, held)) > GATHERED:
                    yield from out()
                    held.clear()
        if held:
            yield from out()

    @trimmed
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in gather(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False, schema=pa.schema([("segment", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        pairs, counts, press = [], [], ZstdDecompressor()
        for n, blob in zip(parts.n, parts.blob, strict=True):
            data = np.frombuffer(press.decompress(blob), np.uint8)
            pairs.append(np.cumsum(data[: 8 * n].reshape(8, n).T.copy().view("<u8").ravel(), dtype=np.uint64))
            c = data[8 * n : 9 * n].astype(np.int64)
            c[c == 255] = data[9 * n :].view("<i8") if (c == 255).any() else 0
            counts.append(c)
        pair, count = np.concatenate(pairs), np.concatenate(counts)
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
        at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pair, count = pair[at], np.add.reduceat(count, at)
        context = pair >> np.uint64(24)
        at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        bits = segment(context[at], np.add.reduceat(count, at), np.diff(np.r_[at, len(pair)]), pair, count)
        return pd.DataFrame({"segment": parts.segment.iloc[:1], "bits": [bits], "ones": [(count == 1).sum()], "twos": [(count == 2).sum()]})

    parts = docs.where("train").select("text", "train").mapInArrow(gathered, "segment int, n long, blob binary")
    return parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary, ones long, twos long")


def _passes(sizes: list[tuple[int, int]], segments: int) -> list[tuple[int, int]]:
    """Runs of segments whose bytes fit a pass."""
    out, low, held = [], 0, 0
    for k, n in sizes:
        if held and held + n > PASS_BYTES:
            out.append((low, k))
            low, held = k, 0
        held += n
    return [*out, (low, segments)]


def _loaded(table_: DataFrame, low: int, high: int, segments: int) -> Broadcast:
    """The segments low..high, at most PASS_BYTES or one segment, sent to the workers."""
    bits = {r["segment"]: r["bits"] for r in table_.where(f"segment >= {low} and segment < {high}").select("segment", "bits").toLocalIterator()}
    parts = [bits.pop(k, bytes(8)) for k in range(low, high)]
    sizes = np.array([len(p) for p in parts], np.int64)
    made = Filter(low, high, 40 - (segments.bit_length() - 1), np.frombuffer(b"".join(parts), np.uint64), (np.cumsum(sizes) - sizes) // 8, (sizes // 8).astype(np.uint64))
    return table_.sparkSession.sparkContext.broadcast(made)


def log_probabilities(levels: np.ndarray, totals: Totals) -> np.ndarray:
    """log10 of the tokens' probabilities from quantised counts: of the context, its followers, the
    bigram and the word (rows of `levels`)."""
    context, types, pair, word = count_of(np.arange(256))[levels]
    uni = (word + 0.1) / (totals.tokens + 0.1 * (totals.distinct + 1))
    safe = np.maximum(context, 1)
    # A false positive or rounding may show more of a bigram or of followers than its context has.
    seen = np.maximum(np.minimum(pair, safe) - totals.discount, 0) / safe
    rest = np.minimum(totals.discount * np.minimum(types, safe) / safe, 1 - seen)
    return np.log10(np.where((context > 0) & (types > 0), seen + rest * uni, uni))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of `docs` with a boolean column `train`.

    Null texts are empty: one token, the end. Null ids and repeated rows are scored like any. Without
    training texts all counts are zero, N and V too, and both scores are 0. Exact counts of the most
    frequent words, a bounded number, go to the workers; those of all others are joined by word, and as no
    frequent word is among them, no join key is hot. A filter of more than PASS_BYTES is read in
    several passes over the texts, each adding the levels that its segments hold.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    counts = written(word_counts(rows), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    # A count from which on at most COMMON_WORDS words are counted; counts fall into a few hundred steps.
    step = F.floor(F.log2("every") * 8)
    least, total = math.inf, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > COMMON_WORDS:
            break
        least = r["step"]
    counts = counts.withColumn("common", step >= (least if least < math.inf else 1 << 30))
    common = spark.sparkContext.broadcast({bytes(r["word"]): math.log10(r["c"] + 0.1) for r in counts.where("common").select("word", "c").toLocalIterator()})
    segments = 1 << max(4, math.ceil(math.log2(max(n, 1) / PER_SEGMENT)) + 1)
    bits = written(filter_segments(rows, segments), "filter")
    ones, twos = bits.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    totals = Totals(n, v, min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5)
    sizes = [(r[0], r[1]) for r in bits.select("segment", F.octet_length("bits")).orderBy("segment").toLocalIterator()]
    passes = _passes(sizes, segments)
    base = math.log10(n + 0.1 * (v + 1))

    def probing(part: Broadcast, first: bool, last: bool):
        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, texts in _batches(batch, 1):
                    x, f = Indexed(texts), part.value
                    own = keys(x.hash)
                    context, types = f.levels(own, own, CONTEXT), np.zeros(len(own), np.uint8)
                    seen = np.flatnonzero(context)  # a context that is not there has no followers to read
                    types[seen] = f.levels(own[seen], own[seen], TYPES)
                    pairs, where = np.unique(x.before * len(x.words) + x.at, return_inverse=True)
                    first_word, second = np.divmod(pairs, len(x.words))
                    pair = f.levels(bigrams(x.hash[second], x.hash[first_word]), own[first_word], PAIR)[where]
                    found = np.stack([context[x.before], types[x.before], pair, context[x.at]])
                    if not first:
                        found = np.maximum(found, np.frombuffer(b"".join(batch.column(3)[lo:hi].to_pylist()), np.uint8).reshape(-1, 4).T)
                    own_id = batch.column(0)[lo:hi]
                    if not last:
                        held = found.T.astype(np.uint8)
                        blobs = pa.array([held[s : s + k].tobytes() for s, k in zip(x.start, x.n, strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays([own_id, batch.column(1)[lo:hi], batch.column(2)[lo:hi], blobs], names=["id", "text", "train", "levels"])
                        continue
                    score = np.add.reduceat(log_probabilities(found, totals), x.start)
                    log = np.array(list(map(common.value.get, x.words)), float)[x.at]  # NaN: not common
                    rare = np.isnan(log)
                    text_of = np.repeat(np.arange(len(texts)), x.n)
                    logs, known = (np.bincount(text_of[~rare], w, len(texts)) for w in (log[~rare], log[~rare] > -0.99))  # log10(0.1) is -1
                    tail, times = np.unique(text_of[rare] * len(x.words) + x.at[rare], return_counts=True)
                    ends = pa.array(np.searchsorted(tail, np.arange(len(texts) + 1) * len(x.words)).astype(np.int32))
                    rare_words = pa.array([x.words[k] for k in (tail % len(x.words)).tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        own_id, batch.column(2)[lo:hi], pa.array(x.n), pa.array(score), pa.array(logs), pa.array(known.astype(np.int64)),
                        pa.ListArray.from_arrays(ends, rare_words), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ], names=["id", "train", "n_tokens", "score", "logs", "known", "rare", "times"])

        return run

    kind = rows.schema["id"].dataType.simpleString()
    done = rows
    for k, (low, high) in enumerate(passes):
        last = k == len(passes) - 1
        run = probing(_loaded(bits, low, high, segments), k == 0, last)
        schema = f"id {kind}, train boolean, n_tokens long, score double, logs double, known long, rare array<binary>, times array<int>" if last else f"id {kind}, text string, train boolean, levels binary"
        done = written(done.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()) if last else done.mapInArrow(run, schema), "scored")
    tail = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    looked = tail.join(counts.where("not common").select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    summed = looked.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + F.lit(0.1))).alias("more"), F.sum(F.when(c > 0, F.col("times"))).alias("more_known"))
    joined = done.drop("rare", "times").join(summed, "row", "left")
    zero = F.lit(0)
    found = F.lit(bool(n))
    return joined.select(
        "id", "train", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.when(found, F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).otherwise(0.0).alias("base_score"), F.when(found, F.col("score")).otherwise(0.0).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder(F.col("doc_id"), 10) != 0).alias("train"))
    out = lm_scores(docs)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
