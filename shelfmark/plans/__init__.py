"""Registered queries, grouped by what they are about."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ("matching", "ledgers", "machines", "urls", "manifests", "responses", "transfers", "files")


def load() -> ModuleType:
    """The registry with every module's queries in it."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
