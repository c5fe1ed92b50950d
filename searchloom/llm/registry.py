"""The training-data queries and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from searchloom.llm import embedding_dedup, exact_dedup, language_id, license_scan, line_dedup, mixing, near_dup, packing, substring_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_suffix_array_dedup": substring_dedup.op2_suffix_array_dedup,
        "op3_minhash_near_dedup": near_dup.op3_minhash_near_dedup,
        "op10_embedding_near_dedup": embedding_dedup.op10_embedding_near_dedup,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_source_mixing": mixing.op8_source_mixing,
        "op9_license_scan": license_scan.op9_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.ORACLE_SQL, "op8_source_mixing": mixing.ORACLE_SQL, "op9_license_scan": license_scan.ORACLE_SQL}
