"""Whole measurements as queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("spectral", "timeline", "pairwise", "catalog", "recordings", "series", "streams")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"undula.plans.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
