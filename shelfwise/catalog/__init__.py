"""The query catalogue. ``load()`` imports every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil
from types import SimpleNamespace

from . import registry


def load() -> SimpleNamespace:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return SimpleNamespace(queries=registry.QUERIES, oracles=registry.ORACLES)
