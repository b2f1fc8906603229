"""Registered queries: each operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ["scalars", "relational", "pipelines", "flows", "extraction"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"rolemill.catalog.{name}")
