"""Registered queries: every operator applied to the given tables."""

from importlib import import_module

MODULES = ["detection", "anonymization", "privacy", "compliance", "tables", "graphs", "operations"]


def load():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
