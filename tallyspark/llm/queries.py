"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tallyspark.llm import alignment, byte_bpe, hard_negatives, iso_media, line_dedup, mixing, ngram_join, quality_rules, suffix_tree, token_counts, toxicity, warc, word_bpe

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_iso_media": iso_media.op5_iso_media,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_tree": suffix_tree.op7_suffix_tree,
    "op8_warc": warc.op8_warc,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "op11_word_bpe": word_bpe.op11_word_bpe,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op1_quality_rules": quality_rules.OP1_SQL, "op2_line_dedup": line_dedup.OP2_SQL, "op8_warc": warc.OP8_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
