"""All queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_chat", "op2_suffix_dedup", "op3_toxicity", "op4_training_order", "op5_minhash", "op6_quality", "op7_language", "op8_mixing", "op9_packing", "op10_exact_dedup", "op11_licenses", "op12_whitening", "op13_vector_codes")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"finlake.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
