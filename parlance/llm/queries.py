"""The queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from parlance.llm import embedding_dedup, fill_middle, html_extract, minhash, mixing, pieces, pii, prefix_trie, quality_mil, quality_rules, secret_scan, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_minhash": minhash.op7_minhash,
        "op8_quality_mil": quality_mil.op8_quality_mil,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_pii": pii.op10_pii,
        "op11_fill_middle": fill_middle.op11_fill_middle,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": secret_scan.OP3_SQL, "op11_fill_middle": fill_middle.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_suffix_dedup": suffix_dedup.OP13_SQL}
