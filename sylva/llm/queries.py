"""Registered corpus queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, exact_dedup, fill_in_middle, language_id, line_dedup, packing, secret_scan, simhash, substring_dedup, suffix_index, token_alignment, token_counts, warc

QUERIES: dict = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op6_suffix_array_dedup": suffix_index.op6_suffix_array_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "pipeline": corpus_pipeline.run,
    "op8_language_id": language_id.op8_language_id,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_warc": warc.op11_warc,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES: dict = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op6_suffix_array_dedup": suffix_index.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_secret_scan": secret_scan.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_warc": warc.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
