"""The registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from corpusmill.llm import (
    exactdedup, gridjoin, hardneg, langid, packing, resampling, secrets, sharding, simhash, substrings, surrogates, tokenfile, wordbpe,
)

QUERIES = {
    "op1_repeated_passages": substrings.op1_repeated_passages,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_shard_table": sharding.op3_shard_table,
    "op4_simhash_components": simhash.op4_simhash_components,
    "op5_grid_join": gridjoin.op5_grid_join,
    "op6_language": langid.op6_language,
    "op7_word_bpe": wordbpe.op7_word_bpe,
    "op8_exact_dedup": exactdedup.op8_exact_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_packing": packing.op10_packing,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_token_files": tokenfile.op12_token_files,
    "op13_resampling": resampling.op13_resampling,
}

ORACLES = {
    "op3_shard_table": sharding.OP3_SQL,
    "op8_exact_dedup": exactdedup.OP8_SQL,
    "op9_secret_scan": secrets.OP9_SQL,
    "op11_hard_negatives": hardneg.OP11_SQL,
    "op13_resampling": resampling.OP13_SQL,
}
