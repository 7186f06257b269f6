"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every registry module once and return (queries, oracles)."""
    from lumenads.registry import core

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return core.QUERIES, core.ORACLES
