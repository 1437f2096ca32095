"""The registered queries of this subpackage and their SQL."""

from stockbook.llm import byte_bpe, html_text, lm_scoring, media, mixing, near_dedup, pieces, quality_classifier, quality_rules, spelling, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op3_pieces": pieces.op3_pieces,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_toxicity": toxicity.op10_toxicity,
    "op5_html_text": html_text.op5_html_text,
    "op7_media": media.op7_media,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
}
