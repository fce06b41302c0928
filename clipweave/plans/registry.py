"""All queries on the media operators, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("intervals", "catalog", "candidates", "timeline", "levels", "sources")


def collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"clipweave.plans.{name}"), attribute)
    return out
