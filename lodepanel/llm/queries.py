"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, cotraining, decontaminate, hard_negatives, html_tree, mixing, quality_rules, sharding, simhash, spelling, tokens, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_simhash": simhash.op3_simhash,
    "op4_html_tree": html_tree.op4_html_tree,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_cotraining": cotraining.op8_cotraining,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
