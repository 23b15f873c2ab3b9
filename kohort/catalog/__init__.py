"""Registered queries: each binds an operator to the test tables, with its DuckDB twin."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

SECTIONS = [
    "reports",
    "fields",
    "joins",
    "statistics",
    "folding",
    "similarity",
    "sources",
    "preparing",
    "learning",
    "searching",
]
for section in SECTIONS:
    import_module(f"{__name__}.{section}")

__all__ = ["ORACLES", "QUERIES"]
