"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

#: Modules that hold the operators, in the order of their numbers.
MODULES = ("secrets", "lines", "urls", "bpe", "mixing", "quality", "njaccard", "lattice", "neighbours", "licenses")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(importlib.import_module(f"{__name__}.{module}"), name))
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
