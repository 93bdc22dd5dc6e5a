"""The subpackage's queries by name, with SQL where it can tell the same; tests/llm holds the others against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, licenses, line_rules, lm_score, near_dup, neighbours, packing, quality, secrets, spelling, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_packing,
    "op2_minhash_near_dedup": near_dup.op2_near_dup,
    "op3_quality_classifier": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_lm_scoring": lm_score.op6_lm_score,
    "op7_nearest_neighbours": neighbours.op7_nearest,
    "op8_quality_rules": line_rules.op8_line_rules,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_spelling_variants": spelling.op11_spelling,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op8_quality_rules": line_rules.SQL, "op10_url_filter": url_filter.SQL, "op11_spelling_variants": spelling.SQL}
