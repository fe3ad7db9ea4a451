"""Registered queries and, where SQL can say the same, their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["inputs", "splits", "screening", "thresholds", "boxes", "stats"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for group in GROUPS:
        part = getattr(import_module(f"{__name__}.{group}"), attribute)
        clash = out.keys() & part.keys()
        assert not clash, f"registered twice: {sorted(clash)}"
        out.update(part)
    return out


def registered_queries() -> dict:
    return _merged("QUERIES")


def registered_oracles() -> dict:
    return _merged("ORACLES")
