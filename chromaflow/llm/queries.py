"""The queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, impact_topk, jaccard_join, licenses, mixing, repetition, rule_quality, substring_dedup, token_orc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_html_min_cut": html_text.query,
    "op2_repetition_rules": repetition.query,
    "op3_entropy_mixing": mixing.query,
    "op4_token_orc": token_orc.query,
    "op5_rule_ensemble": rule_quality.query,
    "op6_impact_topk": impact_topk.query,
    "op7_grouped_prefix_join": jaccard_join.query,
    "op8_recompression_dedup": substring_dedup.query,
    "op9_prefix_bpe": bpe.query,
    "op10_license_rules": licenses.query,
}

#: Only where SQL gives the whole result; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_repetition_rules": repetition.ORACLE,
    "op6_impact_topk": impact_topk.ORACLE,
    "op7_grouped_prefix_join": jaccard_join.ORACLE,
    "op8_recompression_dedup": substring_dedup.ORACLE,
}
