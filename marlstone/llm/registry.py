"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from marlstone.llm import bpe_codec, decontamination, fuzzy_lines, hard_negatives, html_text, language_id, quality_classifier, quality_rules, set_join, simhash, suffix_dedup, token_counts, vector_codes

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_simhash": simhash.query,
    "op3_token_counts": token_counts.query,
    "op4_quality_rules": quality_rules.query,
    "op5_bpe_codec": bpe_codec.query,
    "op6_fuzzy_lines": fuzzy_lines.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_decontamination": decontamination.query,
    "op9_html_text": html_text.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_set_join": set_join.query,
    "op12_vector_codes": vector_codes.query,
    "op13_hard_negatives": hard_negatives.query,
}
SQL = {"op4_quality_rules": quality_rules.SQL, "op8_decontamination": decontamination.SQL, "op12_vector_codes": vector_codes.SQL, "op13_hard_negatives": hard_negatives.SQL}
