"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import bpe, conversations, divergence, line_dedup, lm_scoring, minhash, mixing, perplexity, personal, quality_rules, telephony, token_files, toxicity

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_telephony": telephony.op2_telephony,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_lm_scores": lm_scoring.op5_lm_scores,
    "op6_perplexity": perplexity.op6_perplexity,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op9_token_files": token_files.op9_token_files,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_personal_data": personal.op13_personal_data,
}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_personal_data": personal.OP13_SQL,
}
