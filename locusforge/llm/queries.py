"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from locusforge.llm import (byte_bpe, conversation_repair, decontamination, embedding_dedup, line_dedup, periodic_runs,
                            quality, quality_rules, sharding, simhash, substring_dedup, token_files, warc)

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_quality_pu": quality.op2_quality_pu,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_warc_round_trip": warc.op4_warc_round_trip,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_jump_hash_shards": sharding.op7_jump_hash_shards,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_embedding_near_dedup": embedding_dedup.op11_embedding_near_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

# Fingerprint links, trained scores, tokenizers, jump hashes, CRC-32 and cheapest
# edits have no SQL form, and runs none that whole tables bear; those queries
# are tested against brute force.
ORACLE_SQL = {
    "op4_warc_round_trip": warc.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_benchmark_decontamination": decontamination.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_embedding_near_dedup": embedding_dedup.OP11_SQL,
}
