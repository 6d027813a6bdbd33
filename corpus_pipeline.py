"""From raw documents to token ids: toxicity, exact and near duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before returned, written as Parquet
and read again. All but the last return the columns of documents. An empty table stays empty in each of
them, and further columns, whatever their names, are kept by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import exact_dedup, mixing, sentencepiece, simhash, toxicity
from foldwise.llm.common import in_small_batches, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold, by a machine fitted on the folder's labels outside the held-out
    third. Null and empty texts are clean; repeated rows stay or go together; a null id is never labelled."""
    in_small_batches(spark)
    scored = toxicity.scored(docs, toxicity.fitted(spark, sf_dir, docs))
    return scored.where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each class of equal texts, of equally long ones that of the smallest id (null last).
    Null and empty texts are one class; rows that repeat the id of the one that stays stay with it."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, an exact similarity of 0.8 or
    more. Texts of no words are one group; rows of null ids stay; rows that repeat an id stay together."""
    in_small_batches(spark)
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null sources are one source, texts of no words have
    size 0 but are taken at their source's rate, rows that repeat an id are taken equally often."""
    return mixing.mixed(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the SentencePiece ids of each document; null and empty texts have no ids."""
    in_small_batches(spark)
    return sentencepiece.with_ids(docs, sentencepiece.model_path()).select("doc_id", "lang", "source", "token_ids")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", tokenised),
]

#: The stages of fitted scores, fingerprints and token ids are beyond SQL; tests hold each to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
