"""The operators' queries and SQL, by name."""

from __future__ import annotations

import importlib
import pkgutil

from tidelog import llm

QUERIES, ORACLE = {}, {}
for _m in sorted(m.name for m in pkgutil.iter_modules(llm.__path__)):
    if _m.startswith("op"):
        _mod = importlib.import_module(f"{llm.__name__}.{_m}")
        QUERIES |= _mod.QUERIES
        ORACLE |= _mod.ORACLE
