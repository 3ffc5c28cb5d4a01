"""Queries over the driver tables, one module per group of operators."""

from __future__ import annotations

import importlib
import pkgutil

from tidemark.plans.registry import QUERIES, Query


def load_all() -> dict[str, Query]:
    """Import every `q_*` module of this folder and return the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    return dict(QUERIES)
