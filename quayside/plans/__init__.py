"""Domain views over the given tables and the registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, so that its queries are registered."""
    for module in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{module.name}")
