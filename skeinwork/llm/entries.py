"""Queries and SQL of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import centroid_clustering, chat_format, decontam, language_id, lm_score, mixing, packing, prefix_trie, quality_rules, simhash_dedup, suffix_dedup, token_count, token_output


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_decontaminate": decontam.op2_decontaminate,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_mix": mixing.op4_mix,
        "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_token_output": token_output.op8_token_output,
        "op9_language_id": language_id.op9_language_id,
        "op10_token_count": token_count.op10_token_count,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.ORACLE_SQL,
        "op2_decontaminate": decontam.ORACLE_SQL,
        "op4_mix": mixing.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "op13_centroid_clustering": centroid_clustering.ORACLE_SQL,
    }
