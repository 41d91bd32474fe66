"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

AREAS = ("research", "pricing", "books", "decisions", "live")


def load():
    """(queries, check SQL) of every area."""
    from tickloom.plans.registry import ORACLE, QUERIES
    for area in AREAS:
        import_module(f"tickloom.plans.{area}")
    return dict(QUERIES), dict(ORACLE)
