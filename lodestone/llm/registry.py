"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lodestone.llm import anchors, chat, decontamination, divergence, mixing, neighbours, ngram_join, nn_descent, repair, secrets, suffix_index, tokens, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_nn_descent": nn_descent.query,
    "op3_chat_perspectives": chat.query,
    "op4_template_decontamination": decontamination.query,
    "op5_secret_spans": secrets.query,
    "op6_ngram_join": ngram_join.query,
    "op7_suffix_levels": suffix_index.query,
    "op10_block_anchors": anchors.query,
    "op8_token_files": tokens.query,
    "op9_source_mixing": mixing.query,
    "op11_suffix_repair": repair.query,
    "op12_source_divergence": divergence.query,
    "op13_learned_partitions": neighbours.query,
}
ORACLE_SQL = {
    "op3_chat_perspectives": chat.ORACLE_SQL,
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
}
