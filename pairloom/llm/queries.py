"""The registered queries of the text operators, with their SQL where SQL can express them at the size of the checks."""

from __future__ import annotations

from pairloom.llm import collocations, decontaminate, fill_in_middle, line_dedup, preference_chat, quality_cnn, quality_rules, secret_scan, sentencepiece_lattice, simhash_dedup, substring_dedup, suffix_dedup, token_files

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_quality_cnn": quality_cnn.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_preference_chat": preference_chat.op5,
    "op6_simhash_dedup": simhash_dedup.op6,
    "op7_secret_scan": secret_scan.op7,
    "op8_sentencepiece": sentencepiece_lattice.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_decontaminate": decontaminate.op10,
    "op11_token_files": token_files.op11,
    "op12_fill_in_middle": fill_in_middle.op12,
    "op13_collocations": collocations.op13,
}

ORACLES = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_preference_chat": preference_chat.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
