"""Queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, harmonic_packing, language_crf, license_scan, multi_index, quality_gam, simhash, token_counts, token_matrices, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_multi_index": multi_index.op2_multi_index,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_simhash": simhash.op4_simhash,
    "op5_token_matrices": token_matrices.op5_token_matrices,
    "op6_warc": warc.op6_warc,
    "op7_language": language_crf.op7_language,
    "op8_packing": harmonic_packing.op8_packing,
    "op9_quality": quality_gam.op9_quality,
    "op10_token_counts": token_counts.op10_token_counts,
}

SQL: dict[str, str] = {"op6_warc": warc.OP6_SQL}
