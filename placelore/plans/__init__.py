"""Registered queries: importing the q_* modules fills the registry."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    from placelore.plans import registry

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLE
