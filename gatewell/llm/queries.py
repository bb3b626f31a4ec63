"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_pii": "pii",
    "op2_toxicity": "toxicity",
    "op3_decontamination": "decontamination",
    "op4_url_filter": "url_filter",
    "op10_mixing": "mixing",
    "op5_secrets": "secrets",
    "op6_quality": "quality",
    "op7_ngram_join": "ngram_join",
    "op8_substring_dedup": "substring_dedup",
    "op9_fingerprints": "fingerprints",
    "op11_periodic_runs": "periodic_runs",
    "op12_simhash": "simhash",
    "op13_spelling": "spelling",
}


def queries() -> dict:
    return {name: getattr(import_module(f"gatewell.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"gatewell.llm.{module}"), "ORACLE_SQL", {}).get(name)
        if sql:
            out[name] = sql
    return out
