"""Registered queries over the given tables, each beside its SQL oracle."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every query module once; importing registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
