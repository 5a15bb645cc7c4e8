"""Queries of this subpackage, and the SQL of those that SQL can express."""

from . import langid, lexicon, line_dedup, mixing, near_dup, quality_model, quality_rules, token_counts, token_files, transport

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op2_quality_classifier": quality_model.op2_quality_classifier,
    "op4_transport_streams": transport.op4_transport_streams,
    "op5_language_id": langid.op5_language_id,
    "op6_bpe_lexicon": lexicon.op6_bpe_lexicon,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_duplicates": near_dup.op8_near_duplicates,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "quality_rules_low_limit": quality_rules.quality_rules_low_limit,
}

ORACLE_SQL = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op8_near_duplicates": near_dup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "quality_rules_low_limit": quality_rules.LOW_LIMIT_SQL,
}
