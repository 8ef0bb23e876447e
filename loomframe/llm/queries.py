"""All registered queries of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

import loomframe.llm
from loomframe.llm.registry import QUERIES, SQL

for _module in sorted(m.name for m in pkgutil.iter_modules(loomframe.llm.__path__)):
    if _module.startswith("q_"):
        importlib.import_module(f"loomframe.llm.{_module}")

__all__ = ["QUERIES", "SQL"]
