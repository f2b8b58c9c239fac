"""The queries of this package, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from quern.llm import bpe, chat, decontaminate, hmm, langid, mtree, pages, secrets, simhash, suffixes

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_exact_top_k": mtree.op3_exact_top_k,
    "op4_html_extraction": pages.op4_html_extraction,
    "op5_lm_scoring": hmm.op5_lm_scoring,
    "op6_secrets": secrets.op6_secrets,
    "op7_bpe": bpe.op7_bpe,
    "op8_language_id": langid.op8_language_id,
    "op9_suffix_array_dedup": suffixes.op9_suffix_array_dedup,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op3_exact_top_k": mtree.OP3_SQL,
}
