"""Queries of the training-data operators: name -> callable, and SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .katz_model import op9_katz_scores
from .licence_scan import ORACLE_SQL as LICENCE_SQL
from .licence_scan import op6_licence_scan
from .near_dedup import op10_near_dedup
from .piece_sampling import op7_piece_sampling
from .pii import op2_pii
from .quality_rules import op4_quality_rules
from .repeated_passages import ORACLE_SQL as PASSAGE_SQL
from .repeated_passages import op5_repeated_passages
from .token_counts import op8_token_counts
from .token_output import op3_token_output

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_token_output": op3_token_output,
    "op4_quality_rules": op4_quality_rules,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_licence_scan": op6_licence_scan,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_token_counts": op8_token_counts,
    "op9_katz_scores": op9_katz_scores,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {"op5_repeated_passages": PASSAGE_SQL, "op6_licence_scan": LICENCE_SQL}
