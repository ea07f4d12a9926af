"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, exact_dedup, language_id, line_dedup, lm_score, near_dedup, neighbours, packing, secret_scan

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_bpe": bpe.op6_bpe,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_chat_format": chat_format.OP3_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
