"""All queries of the library itself: each module of this package has QUERIES and ORACLES."""

from __future__ import annotations

import importlib

MODULES = ("catalog", "records", "measures", "audits", "exports", "reviews")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"tesserae.plans.{name}"), attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
