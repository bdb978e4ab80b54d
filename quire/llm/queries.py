"""The registered queries of the package and their DuckDB SQL."""

from __future__ import annotations

from quire.llm import (
    best_position,
    chat_template,
    embedding_passes,
    fill_in_middle,
    lm_cross_entropy,
    minhash_tensor,
    mixing_es,
    packing,
    quality_ordinal,
    repeated_phrases,
    suffix_dedup,
    toxicity_counterfactual,
    weak_supervision,
)

QUERIES = {
    "op1_quality_ordinal": quality_ordinal.op1_quality_ordinal,
    "op2_toxicity_counterfactual": toxicity_counterfactual.op2_toxicity_counterfactual,
    "op3_lm_cross_entropy": lm_cross_entropy.op3_lm_cross_entropy,
    "op4_packing": packing.op4_packing,
    "op5_repeated_phrases": repeated_phrases.op5_repeated_phrases,
    "op6_mixing_es": mixing_es.op6_mixing_es,
    "op7_embedding_passes": embedding_passes.op7_embedding_passes,
    "op8_chat_template": chat_template.op8_chat_template,
    "op9_weak_supervision": weak_supervision.op9_weak_supervision,
    "op10_minhash_tensor": minhash_tensor.op10_minhash_tensor,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_best_position": best_position.op13_best_position,
}

ORACLE_SQL = {
    "op5_repeated_phrases": repeated_phrases.OP5_SQL,
    "op6_mixing_es": mixing_es.OP6_SQL,
    "op7_embedding_passes": embedding_passes.OP7_SQL,
    "op8_chat_template": chat_template.OP8_SQL,
    "op10_minhash_tensor": minhash_tensor.OP10_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_suffix_dedup": suffix_dedup.OP12_SQL,
    "op13_best_position": best_position.OP13_SQL,
}
