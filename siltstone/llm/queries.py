"""Queries of the llm operators."""

from __future__ import annotations

import importlib
import importlib.util

_MODULES = ("labels", "text", "near", "tokens")
_LOADED = [importlib.import_module(f"{__package__}.queries_{m}") for m in _MODULES if importlib.util.find_spec(f"{__package__}.queries_{m}")]
QUERIES = {k: f for m in _LOADED for k, f in m.QUERIES.items()}
SQL = {k: s for m in _LOADED for k, s in m.SQL.items()}
