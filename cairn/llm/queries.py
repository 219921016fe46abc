"""The queries and oracle SQL of this subpackage, gathered from its modules op*_*.py."""

from __future__ import annotations

import importlib
import pkgutil

import cairn.llm

MODULES = [importlib.import_module(f"cairn.llm.{m.name}") for m in pkgutil.iter_modules(cairn.llm.__path__) if m.name.startswith("op")]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
