"""The registered corpus queries and the SQL of those that SQL can express."""

from tidemark.llm import (
    alignment,
    decontaminate,
    divergence,
    licenses,
    line_dedup,
    minhash,
    pii,
    pitman_yor,
    quality_rules,
    sentencepiece,
    substring_dedup,
    token_files,
    toxicity,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_licenses": licenses.op2_licenses,
    "op3_lm_scores": pitman_yor.op3_lm_scores,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_minhash": minhash.op5_minhash,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_files": token_files.op11_token_files,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op2_licenses": licenses.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
}
