"""The subpackage's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import bpe, chat, decontaminate, hard_negatives, language_id, prefix_trie, quality_model, quality_rules, sharding, simhash, token_files, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_files": token_files.op3_token_files,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_chat": chat.op5_chat,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_language_id": language_id.op8_language_id,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_model": quality_model.op10_quality_model,
    "op11_warc": warc.op11_warc,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

#: The others have no SQL form (hash functions, tokenizers, learned models) and are tested by brute force.
ORACLE_SQL = {
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op5_chat": chat.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
