"""The registered query of each text operator, and its SQL where SQL can say it."""

from __future__ import annotations

from . import bpe, context_tree, decontaminate, language_id, near_dedup, quality_rules, sharding, substring_dedup, token_rollup, toxicity

QUERIES = {
    "op1_karmarkar_karp_shards": sharding.op1_karmarkar_karp_shards,
    "op2_dart_minhash_near_dedup": near_dedup.op2_dart_minhash_near_dedup,
    "op3_cross_parsing_language": language_id.op3_cross_parsing_language,
    "op4_token_rollup": token_rollup.op4_token_rollup,
    "op5_super_kmer_dedup": substring_dedup.op5_super_kmer_dedup,
    "op6_context_tree_weighting": context_tree.op6_context_tree_weighting,
    "op7_toxicity_automata": toxicity.op7_toxicity_automata,
    "op8_benchmark_fm_index": decontaminate.op8_benchmark_fm_index,
    "op9_line_frequency_rules": quality_rules.op9_line_frequency_rules,
    "op10_byte_bpe_rank_queue": bpe.op10_byte_bpe_rank_queue,
}
ORACLES = {
    "op2_dart_minhash_near_dedup": near_dedup.SQL,
    "op4_token_rollup": token_rollup.SQL,
    "op5_super_kmer_dedup": substring_dedup.SQL,
    "op8_benchmark_fm_index": decontaminate.SQL,
    "op9_line_frequency_rules": quality_rules.SQL,
}
