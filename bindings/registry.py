"""All registered queries, gathered from the binding modules."""

from __future__ import annotations

import importlib
import pkgutil

import bindings


def _modules():
    for m in sorted(pkgutil.iter_modules(bindings.__path__), key=lambda m: m.name):
        if m.name.endswith("_queries"):
            yield importlib.import_module(f"bindings.{m.name}")


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.SQL)
    return out
