"""Exact duplicates: 128-bit content hashes, bytes compared inside a hash's group. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, written


def normalised(text: Column) -> Column:
    """The text without the characters of SPACES; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _rank(length: Column, doc_id: Column) -> Column:
    """One ordered number for (longest original text, then smallest id, null last), a fixed-width
    aggregation buffer where a struct would force sorting: length * 2^65 + (2^63 - id, null: 0)."""
    offset = F.coalesce(_whole(2**63) - doc_id.cast("decimal(20,0)"), _whole(0))
    return (length.cast("decimal(12,0)") * _whole(2**65) + offset).cast("decimal(38,0)")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(h binary, sha string, keep_id, group_size long), one row per class of equal normalised texts.

    The grouping key is the 128-bit hash and the text itself: equal hashes alone never merge, since the
    grouping compares the bytes. Copies combine before the shuffle, so a text that a third of all rows
    share is sent once per task. Rows are later matched to classes by hash and SHA-256; should two texts of
    one hash also share that, the query stops rather than merge them.
    """
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text)).alias("norm"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("len"))
    grouped = norm.withColumn("h", F.unhex(F.md5("norm"))).groupBy("h", "norm").agg(F.max(_rank(F.col("len"), F.col("id"))).alias("best"), F.count("*").alias("n"))
    offset = F.col("best") % _whole(2**65)
    keep = F.when(offset > 0, (_whole(2**63) - offset).cast("long"))
    found = grouped.select("h", F.sha2("norm", 256).alias("sha"), keep.alias("keep_id"), F.col("n").alias("group_size"))
    one = found.groupBy("h", "sha").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count("*").alias("texts"))
    checked = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long"))
    return one.select("h", "sha", "keep_id", checked.alias("group_size"))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    norm = normalised(F.col(text))
    return docs.withColumns({"__h": F.unhex(F.md5(norm)), "__sha": F.sha2(norm, 256)})


def duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, keep_id, group_size, kept, text_sha256).

    Null texts equal empty ones. Of a class the row with most code points stays, then the smallest id;
    null ids come last. Ids are to be unique: rows that repeat the id of the one that stays count as
    kept with it. A hot class meets many narrow rows in the join, which adaptive execution splits.
    """
    rows = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text").select("id", "__h", "__sha")
    found = written(classes(docs, id_col, text), "exact")
    joined = rows.join(found, (rows["__h"] == found["h"]) & (rows["__sha"] == found["sha"]))
    return joined.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the rows that stay. The join key holds the id, so no class is hot in it."""
    found = classes(docs, id_col, text).select(F.col("h").alias("__h"), F.col("sha").alias("__sha"), F.col("keep_id").alias("__keep"))
    rows = _keyed(docs, text)
    same = (rows["__h"] == found["__h"]) & (rows["__sha"] == found["__sha"]) & rows[id_col].eqNullSafe(found["__keep"])
    return rows.join(found, same, "left_semi").drop("__h", "__sha")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, sha256(norm) AS text_sha256, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""
