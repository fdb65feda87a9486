"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name: its module in this subpackage, and the function in it.
NAMES = {
    "op1_substring_dedup": ("substring_dedup", "op1"),
    "op2_pii": ("pii", "op2"),
    "op3_exact_dedup": ("exact_dedup", "op3"),
    "op4_jaccard_join": ("jaccard_join", "op4"),
    "op5_packing": ("packing", "op5"),
    "op6_toxicity": ("toxicity", "op6"),
    "op7_decontamination": ("decontamination", "op7"),
    "op8_language_id": ("language_id", "op8"),
    "op9_quality": ("quality", "op9"),
    "op10_warc": ("warc", "op10"),
    "op11_spelling": ("spelling", "op11"),
    "op12_suffix_dedup": ("suffix_dedup", "op12"),
    "op13_resampling": ("resampling", "op13"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"lumenlog.llm.{module}"), f) for name, (module, f) in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL texts that the operators' modules keep as SQL."""
    found = {name: getattr(import_module(f"lumenlog.llm.{module}"), "SQL", {}).get(name) for name, (module, _) in NAMES.items()}
    return {k: v for k, v in found.items() if v}
