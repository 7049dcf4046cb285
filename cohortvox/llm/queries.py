"""The registered training-data queries and their SQL twins."""

from __future__ import annotations

from cohortvox.llm import chat, decontaminate, dialogue, lattice, mixing, neardup, oracles, quality, sharding, suffixsort, tokencount, tokenmerge, toxicity, warczip

QUERIES = {
    "op1_lattice_near_dedup": lattice.op1_lattice_near_dedup,
    "op2_byte_cnn_quality": quality.op2_byte_cnn_quality,
    "op3_zip_warc_pages": warczip.op3_zip_warc_pages,
    "op4_positional_decontamination": decontaminate.op4_positional_decontamination,
    "op5_byte_balanced_shards": sharding.op5_byte_balanced_shards,
    "op6_whole_token_counts": tokencount.op6_whole_token_counts,
    "op7_chat_template": chat.op7_chat_template,
    "op8_factorization_toxicity": toxicity.op8_factorization_toxicity,
    "op9_bottomk_near_dedup": neardup.op9_bottomk_near_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_lightest_repair": dialogue.op11_lightest_repair,
    "op12_radix_suffix_dedup": suffixsort.op12_radix_suffix_dedup,
    "op13_merge_path_alignment": tokenmerge.op13_merge_path_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lattice_near_dedup": oracles.OP1,
    "op3_zip_warc_pages": warczip.OP3_SQL,
    "op4_positional_decontamination": oracles.OP4,
    "op5_byte_balanced_shards": oracles.OP5,
    "op7_chat_template": chat.OP7_SQL,
    "op9_bottomk_near_dedup": oracles.OP9,
    "op10_mix_sources": oracles.OP10,
    "op11_lightest_repair": dialogue.OP11_SQL,
    "op12_radix_suffix_dedup": suffixsort.OP12_SQL,
}
