"""All registered queries. Importing a module of ``queries`` registers its entries."""

from __future__ import annotations

import importlib
import pkgutil

from panelwright.plans import queries as _queries
from panelwright.plans.registry import REGISTRY

for _m in pkgutil.iter_modules(_queries.__path__):
    importlib.import_module(f"{_queries.__name__}.{_m.name}")

__all__ = ["REGISTRY"]
