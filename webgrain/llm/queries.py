"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from webgrain.llm import bpe, filter_audit, lines, lm, minhash, mixing, packing, quality, ranked, search, secrets, substrings, token_files


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1,
        "op2_quality_rules": quality.op2,
        "op3_substring_dedup": substrings.op3,
        "op4_mixing": mixing.op4,
        "op5_token_files": token_files.op5,
        "op6_packing": packing.op6,
        "op7_minhash": minhash.op7,
        "op8_lm_scores": lm.op8,
        "op9_top_k": search.op9,
        "op10_secret_scan": secrets.op10,
        "op11_ranked_search": ranked.op11,
        "op12_filter_audit": filter_audit.op12,
        "op13_byte_bpe": bpe.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.ORACLE_OP4,
        "op7_minhash": minhash.ORACLE_OP7,
        "op9_top_k": search.ORACLE_OP9,
        "op11_ranked_search": ranked.ORACLE_OP11,
        "op12_filter_audit": filter_audit.ORACLE_OP12,
    }
