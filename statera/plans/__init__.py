"""Named queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "landing", "segments", "retrieval", "audits", "quality", "operations", "streams")


def load() -> dict:
    """All registered queries by name."""
    from .catalog import CATALOG

    for m in MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    return CATALOG
