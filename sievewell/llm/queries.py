"""The queries of this package and their DuckDB SQL, for the driver's entry module."""

from __future__ import annotations

from sievewell.llm import chat, decontam, divergence, htmltext, jaccard, langid, licenses, lmscore, mixing, packing, quality, rules, vectorcodes

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality_classifier": quality.query,
    "op3_chat_formatting": chat.query,
    "op4_html_extraction": htmltext.query,
    "op5_benchmark_decontamination": decontam.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_license_scans": licenses.query,
    "op8_quality_rules": rules.query,
    "op9_lm_scoring": lmscore.query,
    "op10_language_id": langid.query,
    "op11_source_divergence": divergence.query,
    "op12_vector_codes": vectorcodes.query,
    "op13_packing": packing.query,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op6_ngram_jaccard_join": jaccard.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op7_license_scans": licenses.ORACLE,
    "op8_quality_rules": rules.ORACLE,
    "op9_lm_scoring": lmscore.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_vector_codes": vectorcodes.ORACLE,
}
