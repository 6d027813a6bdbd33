"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Module of each query.
_MODULES = {
    "op1_mixing": "mixing",
    "op2_sentencepiece": "sentencepiece",
    "op3_token_records": "records",
    "op4_language_id": "language_id",
    "op5_simhash": "simhash",
    "op6_toxicity": "toxicity",
    "op7_embedding_dedup": "embedding_dedup",
    "op8_url_filter": "url_filter",
    "op9_exact_dedup": "exact_dedup",
    "op10_lm_scoring": "lm_scoring",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{_MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: getattr(_module(name), name) for name in _MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name in _MODULES if hasattr(m := _module(name), "SQL")}
