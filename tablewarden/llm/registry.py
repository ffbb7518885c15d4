"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tablewarden.llm import (
    annforest, bpe, conversations, ctph, licenses, linededup, packing, phrases, pii, simhash, substrings, suffixes, toxicity,
)

QUERIES = {
    "op1_ann": annforest.op1_ann,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_packing": packing.op5_packing,
    "op6_bpe": bpe.op6_bpe,
    "op7_pii": pii.op7_pii,
    "op8_licenses": licenses.op8_licenses,
    "op9_ctph": ctph.op9_ctph,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_suffixes": suffixes.op11_suffixes,
    "op12_conversations": conversations.op12_conversations,
    "op13_phrases": phrases.op13_phrases,
}
SQL: dict[str, str] = {
    "op4_line_dedup": linededup.ORACLE_SQL,
    "op8_licenses": licenses.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
