"""The registered queries of this subpackage."""

from __future__ import annotations

from millrace.llm import ann, hmm, jaccard, langid, linededup, media, mixing, packing, pii, quality

MODULES = {
    "op1_pii": pii,
    "op2_nearest": ann,
    "op3_jaccard": jaccard,
    "op4_hmm": hmm,
    "op5_language": langid,
    "op6_line_dedup": linededup,
    "op7_image_copies": media,
    "op8_mix_sources": mixing,
    "op9_pack": packing,
    "op10_quality": quality,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
