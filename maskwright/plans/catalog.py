"""All registered queries and their reference SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["scans", "mails", "prepares", "reviews", "evals", "live"]


def _collect(what: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"maskwright.plans.{name}"), what))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
