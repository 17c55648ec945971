"""All registered queries and their reference SQL."""

from __future__ import annotations

import importlib

MODULES = ["scalars", "sources", "filters", "joins", "aggregates", "windows", "texts", "validation", "plans"]


def _load():
    from . import base

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return base


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    base = _load()
    return {n: base.expand(sql) for n, sql in base.ORACLES.items()}
