"""Registered queries over the driver tables, each beside its SQL counterpart."""

from importlib import import_module

MODULES = ("inputs", "fields", "series", "networks", "training", "verification", "flagship")


def load_all():
    """Import every query module; returns (queries, oracle SQL)."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
