"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over the canonical url `host/path...` with the literal tokens that any
match must hold whole. The index keeps each rule under the rarest of its tokens; a url's tokens fetch
candidate rules, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules of one index, which travels to the executors with the task. Longer lists are judged by several
#: indexes, one after the other.
MOST_RULES = 200_000
#: Compiled expressions that a worker keeps.
MOST_COMPILED = 20_000

# Host and path rules with their verdicts.
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Words that, whole in a url, speak against its page.
SPAM_WORDS = ["adult", "betting", "casino", "escort", "jackpot", "nude", "phishing", "poker", "porn", "viagra", "warez", "xxx"]


#: Every host rule is heavier than every word rule.
HOST_WEIGHT = 1_000_000
BEST = T.StructType([T.StructField("weight", T.LongType()), T.StructField("name", T.StringType()), T.StructField("verdict", T.StringType())])


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int  # the larger wins


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host and its subdomains, and paths that start with `path`. Path tokens count only
    where the rule itself ends them."""
    ended = TOKEN.findall(path.lower()) if not path or not path[-1].isalnum() else TOKEN.findall(path.lower())[:-1]
    return Rule(host + path, rf"(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)}){re.escape(path)}" if path else rf"(?:[^/]*\.)?{re.escape(host)}(?=/|$)", (*TOKEN.findall(host.lower()), *ended), verdict, HOST_WEIGHT + len(host + path))


def word_rule(word: str, verdict: str = "block") -> Rule:
    return Rule(word, rf"(?i:.*(?<![a-z0-9]){re.escape(word)}(?![a-z0-9]))", (word,), verdict, len(word))


class Index:
    """Rules under their rarest token; a rule of no token is a candidate for every url. An expression is
    compiled when its rule is first a candidate, so the index travels as plain text."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        rules = list(rules)
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; an index holds at most {MOST_RULES}")
        often = Counter(t for r in rules for t in set(r.tokens))
        self.by_token: dict[str, list[Rule]] = defaultdict(list)
        self._compiled: dict[str, re.Pattern] = {}
        for r in rules:
            rarest = min(r.tokens, key=lambda t: (often[t], -len(t), t), default="")
            self.by_token[rarest].append(r)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compiled": {}}

    def candidates(self, url: str) -> list[Rule]:
        return [r for t in {"", *TOKEN.findall(url.lower())} if t in self.by_token for r in self.by_token[t]]

    def fits(self, rule: Rule, url: str) -> bool:
        if (pattern := self._compiled.get(rule.pattern)) is None:
            if len(self._compiled) >= MOST_COMPILED:
                self._compiled.clear()
            pattern = self._compiled[rule.pattern] = re.compile(rule.pattern, re.DOTALL)
        return pattern.match(url) is not None

    def best(self, url: str) -> Rule | None:
        """The heaviest rule that matches from the start of `host/path`; ties by name."""
        return max((r for r in self.candidates(url) if self.fits(r, url)), key=lambda r: (r.weight, r.name), default=None)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a url; both empty if it is null or has no `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    capitals, letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), capitals, letters), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = HOST_RULES, words: list[str] = SPAM_WORDS) -> DataFrame:
    """`pages` with host, path, rule and verdict in columns __host, __path, __rule, __verdict.

    The longest host rule decides; else a word rule blocks (its own name isn't returned); else the url
    is allowed. Null and empty urls fit no rule and are allowed; urls of any length are judged whole, repeated ones
    each by itself; an empty table gives none. No shuffle: each url is judged where it is read. Of more than
    MOST_RULES rules each index of so many finds its best, a pass and a written table each, and the best of
    all decides. Columns of the names above are overwritten.
    """
    every = [*(host_rule(*r) for r in rules), *(word_rule(w) for w in words)]
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"__host": host, "__path": path, "__best": F.lit(None).cast(BEST)})
    for lo in range(0, len(every), MOST_RULES):
        out = out.withColumn("__best", F.greatest("__best", _judge(Index(every[lo : lo + MOST_RULES]))("__host", "__path")))
        if lo + MOST_RULES < len(every):
            out = written(out, "judged")
    named = F.when(F.col("__best.weight") >= HOST_WEIGHT, F.col("__best.name"))
    return out.withColumns({"__rule": named, "__verdict": F.coalesce("__best.verdict", F.lit("allow"))}).drop("__best")


def _judge(index: Index) -> Callable[..., Column]:
    """The best rule of an index; heavier structs are greater, and of equal weights the later name."""

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in batches:
            found = [index.best(h + p) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame({"weight": pd.array([r.weight if r else 0 for r in found], dtype="int64"), "name": [r.name if r else "" for r in found], "verdict": [r.verdict if r else "allow" for r in found]})

    return F.pandas_udf(judge, BEST)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", *(F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {" ".join(f"WHEN ends_with('.' || host, '.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in HOST_RULES)}
  WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])({"|".join(SPAM_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
