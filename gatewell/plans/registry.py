"""All queries of the analytics engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sources.files", "sources.publish", "operators.gates", "operators.report", "operators.checks", "operators.cube", "operators.baseline", "operators.forecast", "operators.regress", "operators.sample", "operators.panel", "operators.summary", "operators.geo", "operators.hierarchy", "operators.leaks", "streaming.windows")


def _modules():
    return [import_module(f"gatewell.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in m.ORACLES.items()}
