"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .ctw import op6_context_tree_weighting
from .decontaminate import OP7_SQL, op7_winnowing_decontamination
from .dedup_simhash import op10_simhash_near_dedup
from .dedup_suffix import op2_prefix_free_dedup
from .packing import op5_cutting_stock_packing
from .quality import op9_rule_ensemble_quality
from .repetition import OP3_SQL, op3_repetition_coverage
from .secrets import op4_blob_ledger_secret_scan
from .token_store import op8_elias_fano_tokens
from .toxicity import op1_toxic_segments

QUERIES = [op1_toxic_segments, op2_prefix_free_dedup, op3_repetition_coverage, op4_blob_ledger_secret_scan, op5_cutting_stock_packing, op6_context_tree_weighting, op7_winnowing_decontamination, op8_elias_fano_tokens, op9_rule_ensemble_quality, op10_simhash_near_dedup]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {"op3_repetition_coverage": OP3_SQL, "op7_winnowing_decontamination": OP7_SQL}
