"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; one binary classifier per bit (logistic regression on hashed n-gram
frequencies) predicts that bit; decoding takes the codeword of least weighted loss, a bit's weight
following from its classifier's accuracy, and flags close calls.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, trimmed, written

ORDERS, BUCKETS = (1, 2, 3), 1 << 13
#: Bound of the distinct texts that the driver fits on, in equal shares of the languages, each of which has
#: LEAST at least.
SAMPLE, LEAST = 3000, 4
LETTER = re.compile(r"[^\W\d_]")
#: Best and second probability closer than this: ambiguous.
CLOSE = 0.2
_BLOCK = 1 << 18


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole lower-cased text, in blocks that overlap so that none is lost or doubled."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    for lo in range(0, len(data), _BLOCK):
        for n in ORDERS:
            a = data[lo : lo + _BLOCK + n - 1].astype(np.uint32)
            if len(a) < n:
                continue
            code = np.full(len(a) - n + 1, n, np.uint32)
            for k in range(n):
                code = code << np.uint32(8) | a[k : len(a) - n + 1 + k]
            yield (code * np.uint32(2654435761)) >> np.uint32(19)


def frequencies(text: str) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for g in grams(text):
        counts += np.bincount(g, minlength=BUCKETS)
    return counts / max(1, counts.sum())


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A +1/-1 codeword per class: all distinct splits up to six classes, else the random code of many
    drawn whose closest codewords lie farthest apart."""
    if n == 0:
        return np.zeros((0, 0))
    if n <= 6:
        bits = [[1 if c == 0 or not (b >> (c - 1)) & 1 else -1 for c in range(n)] for b in range(1, 2 ** max(0, n - 1))]
        return np.array(bits, np.float64).reshape(-1, n).T
    width, best, gap = 10 * math.ceil(math.log2(n)), None, -1
    rng = np.random.default_rng(seed)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, (np.abs(code.sum(0)) < n)]
        near = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9).min()
        if near > gap:
            best, gap = code, near
    return best


@dataclass
class Coder:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    w: np.ndarray  # buckets x bits, for mean over grams
    b: np.ndarray
    weights: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.b)), 0
        for g in grams(text):
            total += self.w[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(1, n) + self.b

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities of the languages: softmax of the negative weighted logistic losses."""
        loss = np.logaddexp(0, -self.codes * margins) @ self.weights
        p = np.exp(loss.min() - loss)
        return p / p.sum()

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, ambiguous); `und` for null texts and those of no letter, or if no language was learned."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        p = self.decode(self.margins(text))
        first = int(p.argmax())
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        return self.languages[first], float(p[first]), bool(p[first] - second < CLOSE)


def fit(langs: list[str], x: np.ndarray, steps: int = 150, rate: float = 0.05) -> Coder:
    """Fits from languages and rows of frequencies, which are scaled in place so that common grams don't rule."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Coder(languages, codes, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    scale = (1 / np.sqrt(x.mean(0) + 1e-4)).astype(np.float32)
    x *= scale
    y = codes[[languages.index(lang) for lang in langs]].astype(np.float32)
    w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        g = x.T @ pull + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= 0.5 * pull.sum(0)
    right = ((x @ w + b) * y > 0).mean(0)
    weights = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    return Coder(languages, codes, w * scale[:, None], b.astype(np.float64), weights / weights.mean())


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fit_sample(rows: DataFrame) -> Coder:
    """A coder from rows (text, lang); others columns don't matter, rows of null text or lang don't count.

    Of each language the distinct texts of the smallest hashes, SAMPLE in all or LEAST of each language if
    that is more, so copies of a text count once and no language is lost. Without rows all texts are `und`.
    """
    known = rows.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    languages = known.select("lang").distinct().count()
    if not languages:
        return fit([], np.zeros((0, BUCKETS), np.float32))
    quota = max(LEAST, SAMPLE // languages)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # tasks send no more than the quota
    drawn = known.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= quota).select("lang", "h")
    drawn = written(drawn, "drawn")  # no more rows than the bound

    @trimmed
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [frequencies(t) for t in batch.text]
            at = [np.flatnonzero(f) for f in rows]
            yield pd.DataFrame({"lang": batch.lang, "at": [k.astype("<u2").tobytes() for k in at], "x": [f[k].astype("<f4").tobytes() for f, k in zip(rows, at, strict=True)]}, dtype=object)

    texts = known.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    langs, x = [], np.zeros((quota * languages, BUCKETS), np.float32)
    for k, r in enumerate(texts.select("lang", "text").mapInPandas(features, "lang string, at binary, x binary").toLocalIterator()):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f4")
        langs.append(r["lang"])
    return fit(langs, x[: len(langs)])


def identified(docs: DataFrame, coder: Coder, text: str = "text") -> DataFrame:
    """`docs` with __lang, __score (0 to 1) and __ambiguous, from each whole text alone. No shuffle.

    Null and letterless texts are `und`, score 0; of equal losses the first language by name wins, and is
    ambiguous. Repeated rows get equal results, an empty table none; columns of the three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)  # at most BUCKETS x bits numbers

    @trimmed
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value(t) for t in texts], columns=["lang", "score", "ambiguous"])

    udf = F.pandas_udf(run, "lang string, score double, ambiguous boolean")
    out = docs.withColumn("__found", udf(F.col(text)))
    return out.withColumns({f"__{c}": F.col(f"__found.{c}") for c in ("lang", "score", "ambiguous")}).drop("__found")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(F.col("doc_id"), 4) == 2)
    coder = fit_sample(docs.where(~F.col("held_out")).select("text", "lang"))
    out = identified(docs.select("doc_id", "held_out", "text"), coder)
    return out.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__ambiguous").alias("ambiguous"))
