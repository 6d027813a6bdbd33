"""Mixing sources to target weights: repetition rates from token totals, hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Weights of the sources in code-point order, repeating.
CYCLE = (1, 2, 3)
#: No target exceeds so many times its source's size.
CAP = 3
SEED = "mix-1"


def size(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, whole, part) from rows (source, size); the rate is whole + part.

    A target is the smaller of cap times the size and weight times a level. Sources sorted by
    cap * size / weight fill up in that order, so the level is the first that, given those filled
    before, reaches no further source (the greatest such, as levels fall from there); this is where
    sharing the excess again and again ends.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in cycle)), (order % len(cycle) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("full", F.col("source_size") * cap)
    before = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("full"))
    t = t.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(every))
    filled = F.coalesce(F.col("level") * F.col("weight") >= F.col("full"), F.lit(True))
    target = F.when(filled, F.col("full").cast("double")).otherwise(F.col("level") * F.col("weight"))
    rate = F.when(filled, F.lit(float(cap))).otherwise(F.col("target") / F.col("source_size"))
    t = t.withColumn("target", target).withColumn("rate", rate)
    return t.select("source", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id's 52 first bits of MD5: the same on every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def rated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """`docs` with __size, __source_size, __target and __copies: floor(rate), and one more with probability
    equal to the fraction.

    Null sources are a source of their own, last in the order; empty texts have size 0; rows that repeat
    an id get the same copies; an empty table gives none. Sizes are summed before the shuffle. The table of
    sources is written first, so the planner broadcasts it only while its size is below the session's
    threshold; beyond, it is an equi-join that adaptive execution splits at hot sources.
    """
    sized = docs.withColumn("__size", size(F.col(text)))
    t = written(targets(sized.select(F.col(source).alias("source"), F.col("__size").alias("size"))), "targets")
    t = t.select(*(F.col(c).alias(f"__{c}") for c in t.columns))
    joined = sized.join(t, sized[source].eqNullSafe(t["__source"])).drop("__source")
    more = (chance(F.col(id_col), seed) < F.col("__part")).cast("long")
    return joined.withColumn("__copies", F.col("__whole") + more).drop("__whole", "__part")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; its columns keep their values whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(source).alias("source"))
    out = rated(packed, "id", "text", "source", seed)
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))))
    return out.select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rated(docs).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {CAP} AS f FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(f) OVER p, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS lv
      FROM w WINDOW p AS (ORDER BY f::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(lv) FILTER (WHERE lv * weight <= f) OVER () AS level FROM l),
t AS (SELECT *, CASE WHEN level IS NULL OR level * weight >= f THEN f::DOUBLE ELSE level * weight END AS target FROM m),
r AS (SELECT *, CASE WHEN level IS NULL OR level * weight >= f THEN {CAP}.0::DOUBLE ELSE target / source_size END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
