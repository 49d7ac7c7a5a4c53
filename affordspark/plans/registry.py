"""Collects the registered queries from every catalog module."""

from __future__ import annotations

_MODULES = [
    "affordspark.plans.catalog",
    "affordspark.plans.q_prepare",
    "affordspark.plans.q_profile",
    "affordspark.plans.q_metrics",
    "affordspark.plans.q_models",
    "affordspark.plans.q_stages",
]


def _load():
    import importlib
    for m in _MODULES:
        importlib.import_module(m)
    from affordspark.plans.catalog import ORACLE, QUERIES
    return QUERIES, ORACLE


def all_queries():
    return dict(_load()[0])


def all_oracles():
    return dict(_load()[1])
