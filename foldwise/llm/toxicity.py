"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel of two words sums, over all three-letter subsequences that both hold, the product of their
weights, where a subsequence that spans s letters (at most SPAN) weighs DECAY ** s: letters put in
between lower a match but don't break it. Two pairs of words have the product of their words' kernels.

Two machines make a cascade: one is linear in the features of its landmarks, so it is one weight per
subsequence and passes most words quickly; what it suspects is judged by one of the kernel's square, which tells
a word from its stem. They are fitted on labelled sentences: those of clean texts are clean, those of a toxic text are a bag
of which one at least is toxic. A sentence scores as its worst word or pair of words, which is also what it is
fitted by; which that is, and which sentences of a bag are toxic, is chosen anew in each round. A text scores as its worst sentence; a logistic curve makes this a probability.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, written
from .language_id import id_remainder

LENGTH, SPAN, DECAY = 3, 7, 0.6
ALPHABET, START, END = 42, 40, 41
#: Longer words are read in windows of so many letters, each starting half a window on.
WINDOW = 16
#: Bounds of the labelled sample, in documents: of either label, chosen by hash.
TOXIC_DOCS, CLEAN_DOCS = 3000, 12000
#: Bounds of what the driver fits on: toxic and clean sentences of different worst words a round, pairs, landmarks.
TOXIC_WORDS, CLEAN_WORDS, PAIRS, LANDMARKS = 2000, 3000, 64, 160
#: Rounds of fitting; letters of the parts of words by which the first round tells sentences of a bag apart.
ROUNDS, PART = 3, 5
#: Words of a pair stand at most so many words apart in their sentence, and each is at least so near a landmark's word.
NEAR, ALIKE = 4, 0.75
#: Odds against the other label from which a part of a word counts as toxic alone, and as half of a pair.
ALONE, TOGETHER = 9.0, 1.5
#: Margin of the linear machine from which the other judges a word; what it doesn't judge has the margin FLOOR.
GATE, FLOOR = -1.0, -1.5
THRESHOLD = 0.7
# Signs that stand for letters inside a word.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
SPELLED = re.compile(r"(?<!\S)(?:\S[ \t\n\r\f\v]+){3,}\S(?!\S)")
SENTENCE = re.compile(r"[^.!?\n]+")
INNER_SIGN = re.compile(r"[0-9@$!](?=[0-9@$!]*[^\W\d_])")


def units(token: str) -> list[str]:
    """The letter strings of a token: all its letters joined, and each part between other characters."""
    token = token.lower()
    if token.isalpha():
        return [token]
    if INNER_SIGN.search(token):
        token = INNER_SIGN.sub(lambda m: m[0].translate(SIGNS), token)
    parts = [p for p in re.split(r"[\W\d_]+", token) if p]
    return list(dict.fromkeys(["".join(parts), *(p for p in parts if len(p) >= LENGTH)])) if parts else []


def tokens(text: str) -> list[str]:
    """The words of a text, and words spelled out with spaces as if joined."""
    return [*text.split(), *("".join(m[0].split()) for m in SPELLED.finditer(text))]


def coded(words: list[str]) -> np.ndarray:
    """The letter codes of words of one length, as rows."""
    signs = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)
    out = np.empty((len(words), signs.shape[1] + 2), np.int32)
    out[:, 0], out[:, -1] = START, END
    out[:, 1:-1] = np.where((signs >= 97) & (signs <= 122), signs - 96, 27 + signs % 13)
    return out


def letters(unit: str) -> list[int]:
    return coded([unit])[0].tolist()


def windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[k : k + WINDOW] for k in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the subsequences of n letters, and their weights."""
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))], np.int32).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length (rows of letter codes): subsequences and weights scaled to norm one."""
    at, weight = _triples(codes.shape[1])
    c = (codes[:, at[:, 0]] * ALPHABET + codes[:, at[:, 1]]) * ALPHABET + codes[:, at[:, 2]]
    # A word of WINDOW letters has fewer than 256 subsequences: sorting them with their places is a stable sort.
    c = np.sort(c * 256 + np.arange(c.shape[1], dtype=np.int32), axis=1)
    total = np.cumsum(weight[c & 255], axis=1)
    c >>= 8
    last = np.ones(c.shape, bool)
    last[:, :-1] = c[:, 1:] != c[:, :-1]
    # The weight of a run of equal subsequences stands at its last place.
    upto = np.where(last, total, 0)
    before = np.maximum.accumulate(upto, axis=1)
    w = np.where(last, total - np.concatenate([np.zeros((len(c), 1)), before[:, :-1]], axis=1), 0)
    return c, w / np.sqrt((w * w).sum(axis=1, keepdims=True))


@dataclass
class Features:
    """Scaled subsequence weights of words, as padded rows of places and weights."""

    at: np.ndarray
    weight: np.ndarray

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Products with a dense vector over all subsequences: kernels, if it is another word's."""
        return (dense[self.at] * self.weight).sum(axis=1, dtype=np.float64)

    def dense(self, k: int) -> np.ndarray:
        out = np.zeros(ALPHABET**LENGTH, np.float32)
        np.add.at(out, self.at[k], self.weight[k])
        return out


def features(words: list[str]) -> Features:
    """Features of the few words that are fitted on; no word is longer than WINDOW."""
    width = len(_triples(WINDOW + 2)[0])
    out = Features(np.zeros((len(words), width), np.int32), np.zeros((len(words), width), np.float32))
    for k, word in enumerate(words):
        c, w = subsequences(coded([word]))
        out.at[k, : c.shape[1]], out.weight[k, : c.shape[1]] = c[0], w[0]
    return out


class Table:
    """The subsequence weights of a few words, for those subsequences that they hold."""

    def __init__(self, words: list[str]) -> None:
        x = features(words)
        used = np.unique(x.at[x.weight > 0])
        self.row = np.zeros(ALPHABET**LENGTH, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.weight = np.zeros((len(used) + 1, len(words)), np.float32)
        for k in range(len(words)):
            np.add.at(self.weight[:, k], self.row[x.at[k]], x.weight[k])

    def __call__(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The kernels of a word, given as its subsequences and weights."""
        rows = self.row[c]
        held = np.flatnonzero(rows)
        return w[held].astype(np.float32) @ self.weight[rows[held]]


@dataclass
class Machine:
    weight: np.ndarray  # per subsequence
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    marks: list[str] = field(default_factory=list)  # landmarks of the squared kernel, with weights
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fine_bias: float = FLOOR
    halves: list[str] = field(default_factory=list)  # words of the pairs
    pairs: dict[tuple[int, int], float] = field(default_factory=dict)  # places in `halves` -> weight

    def linear(self, words: list[str]) -> np.ndarray:
        """The linear machine's margin of each word."""
        out = np.empty(len(words))
        for part, c, w in _by_length(words):
            out[part] = (self.weight[c] * w).sum(axis=1)
        return out + self.bias

    def margins(self, words: list[str]) -> np.ndarray:
        """The margin of each word: FLOOR, unless the linear machine suspects it and the other finds more."""
        out = np.full(len(words), FLOOR)
        for part, c, w in _by_length(words):
            for k in np.flatnonzero((self.weight[c] * w).sum(axis=1) + self.bias > GATE):
                out[part[k]] = max(FLOOR, float(self.beta @ self._table("marks")(c[k], w[k]) ** 2 + self.fine_bias))
        return out

    def _table(self, name: str) -> Table:
        if (key := f"_{name}") not in self.__dict__:
            self.__dict__[key] = Table(getattr(self, name))
        return self.__dict__[key]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, Table)}

    def near(self, words: list[str]) -> list[tuple[tuple[int, float], ...]]:
        """For each word, the halves of pairs that it is near, with the kernel."""
        out: list[tuple[tuple[int, float], ...]] = [()] * len(words)
        for part, c, w in _by_length(words if self.halves else []):
            for k in range(len(part)):
                found = self._table("halves")(c[k], w[k])
                out[part[k]] = tuple((int(i), float(found[i])) for i in np.flatnonzero(found >= ALIKE))
        return out

    def of_tokens(self, tokens: list[str]) -> list[float]:
        """The worst margin of the units of each token; FLOOR if it has none."""
        parts = list(map(words_of, tokens))
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        found = dict(zip(words, self.margins(words).tolist(), strict=True))
        return [found[p[0]] if len(p) == 1 else max(map(found.__getitem__, p), default=FLOOR) for p in parts]

    def of_pairs(self, near: list[tuple[tuple[int, float], ...]]) -> float:
        """The worst margin of the pairs among the words of a sentence, given what each is near."""
        worst = -math.inf
        at = [k for k, x in enumerate(near) if x]
        for n, i in enumerate(at):
            for j in at[n + 1 :]:
                if j - i > NEAR:
                    break
                for a, x in near[i]:
                    for b, y in near[j]:
                        if (w := self.pairs.get((min(a, b), max(a, b)))) is not None and a != b:
                            worst = max(worst, w * x * y + self.fine_bias)
        return worst

    def probability(self, margin: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.offset, -30, 30)))


def words_of(token: str) -> list[str]:
    """What a token is scored by: its units, long ones in windows."""
    bare = token.lower().rstrip(",.;:!?)").lstrip("(")
    if bare.isalpha() and len(bare) <= WINDOW:  # most tokens: `units` gives the same
        return [bare]
    return [w for u in units(token) for w in windows(u)]


class Remembered:
    """A function of strings, remembered in a dictionary that begins anew when full; this changes no result."""

    def __init__(self, function: Callable[[list[str]], list], most: int = 150_000) -> None:
        self.function, self.most, self.known = function, most, {}

    def __call__(self, strings: Collection[str]) -> dict:
        """What is known, with all of `strings`."""
        if len(self.known) > self.most:
            self.known = {}
        new = [s for s in strings if s not in self.known]
        self.known.update(zip(new, self.function(new), strict=True))
        return self.known


def _all_words(tokens: list[str]) -> list[list[str]]:
    return [words_of(t) for t in tokens]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one length, at most a thousand at once: their places, subsequences and weights."""
    sizes = np.array([len(w) for w in words], int)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for lo in range(0, len(at), 1000):
            part = at[lo : lo + 1000]
            yield part, *subsequences(coded([words[k] for k in part]))


class Scorer:
    """Worst margins of texts; remembers tokens in two generations, which changes no result."""

    def __init__(self, machine: Machine, remembered: int = 200_000) -> None:
        self.machine, self.remembered, self.known, self.older = machine, remembered, {}, {}
        self.near: dict[str, tuple] = {}  # of the few tokens that are near half of a pair

    def learn(self, texts: set[str]) -> None:
        """Makes sure that the tokens are known."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        new = texts.difference(self.known)
        moved = new.intersection(self.older)
        self.known.update((t, self.older[t]) for t in moved)
        fresh = list(new - moved)
        self.known.update(zip(fresh, self.machine.of_tokens(fresh), strict=True))
        if self.machine.pairs:
            if len(self.near) > self.remembered:
                self.near = {}
            lost = list(texts.difference(self.near)) if not self.near else fresh
            parts = [words_of(t) for t in lost]
            found = iter(self.machine.near(list(chain.from_iterable(parts))))
            self.near.update((t, x) for t, p in zip(lost, parts, strict=True) if (x := tuple(chain.from_iterable(next(found) for _ in p))))

    def __call__(self, texts: list[str]) -> list[float]:
        split = [set(tokens(t)) for t in texts]
        self.learn(set().union(*split))
        worst = [max(map(self.known.__getitem__, s), default=FLOOR) for s in split]
        if self.machine.pairs:
            near = self.near
            for k, s in enumerate(split):
                if sum(t in near for t in s) > 1:
                    worst[k] = max(worst[k], *(self.machine.of_pairs([near.get(t, ()) for t in tokens(x)]) for x in SENTENCE.findall(texts[k])))
        return worst


def sentences(text: str, scorer: Scorer) -> list[tuple[str, float]]:
    """The sentences of a text with their probabilities."""
    found = [s for s in SENTENCE.findall(text) if s.strip()]
    return list(zip(found, scorer.machine.probability(np.array(scorer(found))).tolist(), strict=True))


def _landmarks(x: Features, n: int) -> list[np.ndarray]:
    """The words, as dense vectors, that differ most from those picked before (pivoted Cholesky)."""
    count = len(x.at)
    left, basis, picked = np.ones(count), np.zeros((count, 0)), []
    for _ in range(min(n, count)):
        k = int(left.argmax())
        if left[k] < 1e-6:
            break
        picked.append(x.dense(k))
        column = (x.dot(picked[-1]) - basis @ basis[k]) / np.sqrt(left[k])
        basis = np.column_stack([basis, column])
        left = np.maximum(left - column**2, 0)
    return picked


def _newton(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a squared-hinge machine; the labels weigh alike. The last column of z is the bias."""
    cost = np.sqrt(cost)
    for sign in (1, -1):
        cost[y == sign] *= len(y) / 2 / max(cost[y == sign].sum(), 1e-9)
    v = np.zeros(z.shape[1])
    for _ in range(30):  # finite Newton: the rows inside the margin settle
        inside = y * (z @ v) < 1
        a = z[inside] * cost[inside, None]
        new = np.linalg.solve(z[inside].T @ a + ridge * np.eye(len(v)), a.T @ y[inside])
        if np.allclose(new, v, atol=1e-9):
            break
        v = new
    return v


def _whitening(kernel: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(kernel.astype(np.float64))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T


def fit_machine(positive: dict[str, float], negative: dict[str, float], pairs: dict[tuple[str, str], tuple[float, float]] | None = None, ridge: float = 0.3) -> Machine:
    """Squared-hinge machines on Nystroem features, from weighted words, and pairs with a weight of either label."""
    pairs = pairs or {}
    words = [*positive, *negative]
    x, n = features(words), len(positive)
    y = np.r_[np.ones(n), -np.ones(len(negative))]
    cost = np.array([*positive.values(), *negative.values()], float)
    parts = [Features(x.at[:n], x.weight[:n]), Features(x.at[n:], x.weight[n:])]
    marks = np.array([m for part in parts for m in _landmarks(part, LANDMARKS // 2)]).reshape(-1, ALPHABET**LENGTH)
    root = _whitening(marks @ marks.T)
    z = np.column_stack([*(x.dot(m) for m in marks)]) @ root
    v = _newton(np.column_stack([z, np.ones(len(z))]), y, cost, ridge)
    machine = Machine(((root @ v[:-1]) @ marks).astype(np.float32), float(v[-1]))
    # The other machine: toxic words, and clean ones that pass the gate; landmarks are the most frequent of
    # those and the nearest of these.
    at = np.flatnonzero((y > 0) | (machine.linear(words) > GATE))
    first = sorted(positive, key=lambda w: (-positive[w], w))[:LANDMARKS]
    table_ = Table(first)
    kernels = np.array([table_(x.at[k], x.weight[k]) for k in at]).reshape(len(at), -1)
    nearest = sorted((k for k in range(len(at)) if y[at[k]] < 0), key=lambda k: (-kernels[k].max(initial=0), words[at[k]]))[:LANDMARKS]
    machine.marks = [*first, *(words[at[k]] for k in nearest)]
    table_ = Table(machine.marks)
    kernels = np.array([table_(x.at[k], x.weight[k]) for k in at]).reshape(len(at), -1).astype(np.float64) ** 2
    own = {w: k for k, w in enumerate(words[i] for i in at)}
    root = _whitening(kernels[[own[w] for w in machine.marks]])
    z = kernels @ root
    m, k = z.shape[1], len(pairs)
    z = np.block([[z, np.zeros((len(z), k)), np.ones((len(z), 1))], [np.zeros((2 * k, m)), np.repeat(np.eye(k), 2, axis=0), np.ones((2 * k, 1))]])
    both = np.array(list(pairs.values()), float).reshape(-1, 2)
    v = _newton(z, np.r_[y[at], np.tile([1.0, -1.0], k)], np.r_[cost[at], both.ravel()], ridge)
    machine.beta, machine.fine_bias = root @ v[:m], float(v[-1])
    machine.halves = sorted({w for p in pairs for w in p})
    machine.pairs = {tuple(sorted(map(machine.halves.index, p))): float(w) for p, w in zip(pairs, v[m:-1], strict=True)}
    return machine


def _calibrated(machine: Machine, margin: np.ndarray, label: np.ndarray) -> Machine:
    """The logistic curve of the labels over the margins, with Platt's targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, p = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), x.T @ (q - target) + 1e-3 * p)
        p = p - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    machine.slope, machine.offset = max(float(p[0]), 0.1), float(p[1])
    return machine


def _surprise(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Twice the log-likelihood ratio of what texts of either label hold something, against equal shares."""
    share = all_toxic / (all_toxic + all_clean)
    total, out = toxic + clean, 0.0
    for seen, expected in ((toxic, total * share), (clean, total * (1 - share))):
        out += 2 * seen * math.log(seen / expected) if seen else 0
    return out


def _odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    return (toxic + 0.5) / (all_toxic + 1) / ((clean + 0.5) / (all_clean + 1))


def parts_of(word: str) -> set[str]:
    """The runs of PART letters of a word and its ends, and its longer beginnings; shorter words whole."""
    word = f"^{word}$"
    return {*(word[k : k + PART] for k in range(max(1, len(word) - PART + 1))), *(word[:k] for k in range(PART, len(word)))}


class Rates:
    """What the first round scores by: words and parts of words that toxic texts hold far more often. Forms of one
    word may each be too rare to tell, but what they share isn't."""

    def __init__(self, parts: dict[str, float]) -> None:
        self.parts = parts

    def __call__(self, words: list[str]) -> list[float]:
        return [max(self.parts.get(f"={w}", -1.0), *(self.parts.get(p, -1.0) for p in parts_of(w))) for w in words]


def _base_rate(toxic: int, clean: int, why: str) -> Machine:
    """A machine of one score for every text: the share of toxic ones."""
    warnings.warn(f"{why}: every text gets one toxicity score", stacklevel=3)
    return Machine(np.zeros(ALPHABET**LENGTH, np.float32), 2 * GATE, 1.0, -FLOOR + math.log((toxic + 0.5) / (clean + 0.5) if toxic + clean else 1e-2))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Machine:
    """A machine from documents (id, text) and labels (id, toxic 0 or 1; others don't count, of several 1 counts).

    A bounded sample by hash: TOXIC_DOCS and CLEAN_DOCS documents; of texts with the same least shingle (copies,
    most near copies) one, toxic if any is, for what copies share is no evidence. Three quarters fit the machine, the last the curve. Each round reads every sentence of the sample: of a clean text's
    sentences each is an example, of a toxic text's those that score above zero by a word that `Rates` knows.
    Toxic texts where none does teach nothing: labels can be wrong. The first round scores by `Rates`, later ones by
    the machine before. What is rare or met by chance is told from what is toxic by likelihood ratios, so
    some wrong labels bar no word. Null, empty and wordless texts have no sentences. Without labels of
    both kinds, or if nothing tells them apart, a warning is given and all texts score their label's share.
    """
    known = labels.where("toxic in (0, 1)").groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    drawn = [known.where(f"__toxic = {k}").orderBy(F.xxhash64("__id")).limit(n) for k, n in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    picked = written(drawn[0].union(drawn[1]), "labelled")  # no more rows than the two bounds
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(picked), "__id").withColumn("key", _least_shingle("text"))
    rows = rows.groupBy("key").agg(F.max_by("text", F.length("text")).alias("text"), F.max("__toxic").alias("toxic"))
    sample = written(rows.withColumn("curve", F.pmod("key", F.lit(4)) == 0), "sample")
    sizes = {(r["toxic"], r["curve"]): r["count"] for r in sample.groupBy("toxic", "curve").count().collect()}
    n1, n0 = sizes.get((1, False), 0), sizes.get((0, False), 0)
    if not n1 or not n0:
        return _base_rate(n1 + sizes.get((1, True), 0), n0 + sizes.get((0, True), 0), "labels of one kind or none")
    fitting = sample.where("not curve").select("text", "toxic")
    rates, halves = _rates(fitting, n1, n0)
    if not rates.parts and len(halves) < 2:
        return _base_rate(n1, n0, "toxic and clean texts hold the same words")
    clean, machine, pairs = {}, None, None
    for _ in range(ROUNDS):
        toxic, more, found = _examples(fitting, rates, machine, halves if pairs is None else set())
        if pairs is None:
            chosen = sorted(((_surprise(*n, n1, n0), p) for p, n in found.items() if _odds(*n, n1, n0) >= ALONE and n[0] > 2), reverse=True)[:PAIRS]
            least = 2 * math.log(max(2, len(found)))
            pairs = {p: found[p] for g, p in chosen if g >= least}
        clean |= more
        if not clean or not toxic and not pairs:
            break
        machine = fit_machine(toxic, clean, pairs)
    if machine is None:
        return _base_rate(n1, n0, "toxic and clean texts hold the same words")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @trimmed
    def worst(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"margin": scorer(batch.text.tolist()), "toxic": batch.toxic})

    rows = sample.where("curve").select("text", "toxic").mapInPandas(worst, "margin double, toxic int").collect()  # a part of the sample
    found = np.array([tuple(r) for r in rows], float).reshape(-1, 2)
    found = found[found[:, 0] > FLOOR]  # what holds no suspected word says nothing about the curve
    if len(set(found[:, 1])) < 2:
        machine.slope, machine.offset = 4.0, 0.0
        return machine
    return _calibrated(machine, found[:, 0], found[:, 1])


def _least_shingle(text: str) -> Column:
    """The least hash of a text's shingles of five words."""

    def least(texts: pd.Series) -> pd.Series:
        from .simhash import _shingles

        return pd.Series([int(_shingles(t, 5, False, 42).view("<i8").min(initial=0)) for t in texts], dtype="int64")

    return F.pandas_udf(least, "long")(text)


def _rates(fitting: DataFrame, n1: int, n0: int) -> tuple[Rates, set[str]]:
    """Parts of words that tell toxic texts, and whole words that may in pairs."""

    @trimmed
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_in, parts_in = Remembered(_all_words), Remembered(lambda words: [parts_of(w) for w in words], 50_000)
        for batch in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(batch.text, batch.toxic, strict=True):
                in_text = set(tokens(text))
                of = words_in(in_text)
                words = {w for t in in_text for w in of[t]}
                parts = parts_in(words)
                found[toxic].update(set().union(*map(parts.__getitem__, words)))
                found[toxic].update(f"={w}" for w in words)
            keys = list(found[0] | found[1])
            yield pd.DataFrame({"part": pd.Series(keys, dtype=object), "toxic": pd.Series([found[1][k] for k in keys], dtype="int64"), "clean": pd.Series([found[0][k] for k in keys], dtype="int64")})

    counts = fitting.mapInPandas(count, "part string, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = (F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("clean") + 0.5) / (n0 + 1))
    often = written(counts.where("toxic > 2").withColumn("odds", odds), "parts")
    tests = max(2, often.count())
    near = [r for r in often.where(f"odds >= {TOGETHER}").orderBy(F.desc("odds"), F.desc("toxic"), "part").limit(4 * TOXIC_WORDS).collect()]
    told = [r for r in near if _surprise(r["toxic"], r["clean"], n1, n0) >= 2 * math.log(tests)]
    alone = {r["part"]: math.log(r["odds"]) for r in told if r["odds"] >= ALONE}
    return Rates(alone), {r["part"][1:] for r in told if r["part"][0] == "=" and r["odds"] < ALONE and len(r["part"]) > 2}


def _examples(fitting: DataFrame, rates: Rates, machine: Machine | None, halves: set[str]) -> tuple[dict[str, float], dict[str, float], dict[tuple[str, str], tuple[int, int]]]:
    """The worst words of toxic and of clean sentences with the texts that have them, and of the pairs of
    `halves` how many texts of either label have them."""
    shared = fitting.sparkSession.sparkContext.broadcast((rates, machine, halves))

    @trimmed
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rates, machine, halves = shared.value
        words_in, rate_of = Remembered(_all_words), Remembered(rates)
        margin_of = rate_of if machine is None else Remembered(lambda words: machine.margins(words).tolist())
        for batch in batches:
            out: Counter[tuple[str, int, float]] = Counter()
            both: Counter[tuple[str, int, float]] = Counter()
            for text, toxic in zip(batch.text, batch.toxic, strict=True):
                split = [tokens(s) for s in SENTENCE.findall(text)]
                of = words_in(set().union(*split))
                split = [x for s in split if (x := [w for t in s for w in of[t]])]
                words = set().union(*split)
                margin = margin_of(words)
                best = [max(s, key=margin.__getitem__) for s in split]
                if toxic:
                    rate = rate_of(words)
                    best = [w for w in best if margin[w] > 0 and rate[w] > 0]
                out.update((w, toxic, margin[w]) for w in set(best))
                if halves:
                    pairs = {tuple(sorted((s[i], s[j]))) for s in split for i in range(len(s)) if s[i] in halves for j in range(i + 1, min(len(s), i + NEAR + 1)) if s[j] in halves and s[j] != s[i]}
                    both.update((" ".join(p), 2 + toxic, 0.0) for p in pairs)
            rows = [*out.items(), *both.items()]
            yield pd.DataFrame({"word": pd.Series([k[0] for k, _ in rows], dtype=object), "kind": pd.Series([k[1] for k, _ in rows], dtype="int32"), "margin": pd.Series([float(k[2]) for k, _ in rows], dtype="float64"), "n": pd.Series([n for _, n in rows], dtype="int64")})

    found = fitting.mapInPandas(choose, "word string, kind int, margin double, n long").groupBy("word", "kind").agg(F.max("margin").alias("margin"), F.sum("n").alias("n"))
    found = written(found, "examples")
    toxic = found.where("kind = 1").orderBy(F.desc("n"), "word").limit(TOXIC_WORDS)
    hard = found.where("kind = 0").orderBy(F.desc("margin"), F.desc("n"), "word").limit(CLEAN_WORDS // 2)
    some = found.where("kind = 0").orderBy(F.xxhash64("word")).limit(CLEAN_WORDS // 2)
    pairs: dict[tuple[str, str], list[int]] = {}
    for r in found.where("kind > 1").orderBy(F.desc("n"), "word", "kind").limit(40 * PAIRS).collect():
        pairs.setdefault(tuple(r["word"].split(" ")), [0, 0])[3 - r["kind"]] = r["n"]
    return {r["word"]: r["n"] for r in toxic.collect()}, {r["word"]: r["n"] for d in (hard, some) for r in d.collect()}, {p: tuple(n) for p, n in pairs.items()}


def scored(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """`docs` with __score: the probability that its whole text is toxic. No shuffle.

    Null, empty and wordless texts score as clean words do; the longest text is scored whole, in one task. Repeated
    rows get equal scores, an empty table none; a column __score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # ALPHABET ** LENGTH numbers

    @trimmed
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from .words import slices

        scorer = Scorer(shared.value)
        for texts in batches:
            part = ["" if t is None else t for t in texts]
            margins = [m for lo, hi in slices(part) for m in scorer(part[lo:hi])]
            yield pd.Series(shared.value.probability(np.array(margins, float)))

    return docs.withColumn("__score", F.pandas_udf(run, "double")(F.col(text)))


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Machine:
    """The machine of a data folder: from labels of documents outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 3) != 1)
    return fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fitted(spark, sf_dir, docs))
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
