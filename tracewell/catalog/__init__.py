"""Every registered query with its comparison SQL."""

import importlib

from tracewell.catalog.registry import ORACLES, QUERIES

_LANES = ("lexical", "web", "trail", "library", "results")

for _lane in _LANES:
    importlib.import_module(f"tracewell.catalog.{_lane}")

__all__ = ["ORACLES", "QUERIES"]
