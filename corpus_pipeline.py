"""A corpus pipeline over ``documents``: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but the
last return the columns of ``documents``; the last returns the ids of every row of the mix.
An empty table passes through all stages; nulls and odd texts are treated as each
operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import minhash, mixing, pieces, pii, quality_rules
from parlance.llm._common import stored, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules.stage_quality),
    ("minhash_near_dedup", minhash.stage_near_duplicates),
    ("pii", pii.stage_pii),
    ("mixing", mixing.stage_mix),
    ("sentencepiece", pieces.stage_encode),
]

#: Hashed sampling, transducers and piece matching have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result is read from the last stage's table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
