"""Names the queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import bpe, decontamination, fingerprints, lexical, line_dedup, mixing, near_dedup, paragraph_dedup, pii, resampling, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_substring_dedup": paragraph_dedup.op2_substring_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
        "op5_token_id_binary_output": token_files.op5_token_id_binary_output,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
        "op8_pii": pii.op8_pii,
        "op9_byte_level_bpe": bpe.op9_byte_level_bpe,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
        "op11_ranked_search": lexical.op11_ranked_search,
        "op12_mixing": mixing.op12_mixing,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op4_benchmark_decontamination": decontamination.OP4_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op10_minhash_near_dedup": near_dedup.OP10_SQL, "op11_ranked_search": lexical.OP11_SQL, "op13_importance_resampling": resampling.OP13_SQL}
