"""The numbered operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import alignment, decontamination, exact, fixity, html, language, licenses, mixing, neardup, ogg, phrases, pii, substrings

QUERIES = {
    "op10_template_decontamination": decontamination.op10_template_decontamination,
    "op11_phrase_mining": phrases.op11_phrase_mining,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_exact_dedup": exact.op13_exact_dedup,
    "op1_license_scan": licenses.op1_license_scan,
    "op2_merkle_fixity": fixity.op2_merkle_fixity,
    "op3_minhash_neardup": neardup.op3_minhash_neardup,
    "op4_pii_scan": pii.op4_pii_scan,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_ogg_media": ogg.op6_ogg_media,
    "op7_page_differencing": html.op7_page_differencing,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_language_id": language.op9_language_id,
}
ORACLES = {"op11_phrase_mining": phrases.ORACLE, "op13_exact_dedup": exact.ORACLE, "op2_merkle_fixity": fixity.ORACLE, "op8_source_mix": mixing.ORACLE}
