"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from dupeframe.llm import (
    chat_format, collocations, jaccard_join, language_model, licenses, mixing, ordinal, packing,
    quality_rules, simhash, token_output, url_filters, whitening,
)

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_packing": packing.op2_packing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_ordinal_quality": ordinal.op6_ordinal_quality,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_simhash": simhash.op9_simhash,
    "op10_language_model": language_model.op10_language_model,
    "op11_whitening": whitening.op11_whitening,
    "op12_collocations": collocations.op12_collocations,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES = {
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op7_url_filters": url_filters.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
