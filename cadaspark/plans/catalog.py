"""All registered queries with their checking SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

SECTIONS = ["sources", "extract", "crs", "rings", "spatial", "raster", "rules", "screen", "history", "governance"]


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for section in SECTIONS:
        module = importlib.import_module(f"cadaspark.plans.{section}")
        merged.update(getattr(module, attribute))
    return merged


def queries() -> dict[str, Callable]:
    return _merge("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merge("CHECKS")
