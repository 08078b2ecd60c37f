"""Queries of this subpackage for the entry point, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

_OPS = {
    "op1_fingerprints": "fingerprints",
    "op2_mixing": "mixing",
    "op3_license_scan": "licenses",
    "op4_language_id": "langid",
    "op5_jaccard_join": "jaccard",
    "op6_decontamination": "decontaminate",
    "op7_substring_dedup": "substrings",
    "op8_pii": "pii",
    "op9_line_dedup": "lines",
    "op10_run_index": "runindex",
    "op11_quality_rules": "quality",
    "op12_whitening": "whitening",
    "op13_prefix_trie": "trie",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _OPS.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, jaccard, lines, mixing, quality, runindex, substrings, trie

    return {
        "op2_mixing": mixing.OP2_SQL,
        "op5_jaccard_join": jaccard.OP5_SQL,
        "op6_decontamination": decontaminate.OP6_SQL,
        "op7_substring_dedup": substrings.OP7_SQL,
        "op9_line_dedup": lines.OP9_SQL,
        "op10_run_index": runindex.OP10_SQL,
        "op11_quality_rules": quality.OP11_SQL,
        "op13_prefix_trie": trie.OP13_SQL,
    }
