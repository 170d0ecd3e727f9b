"""Queries over the given tables, one module per operator family."""

from importlib import import_module

MODULES = ("tables", "joining", "windowing", "memories", "arrays", "texts", "sampled", "works", "streams", "forms")


def load():
    """Import all query modules and return the registry."""
    for name in MODULES:
        import_module(f"stepweave.catalog.{name}")
    return import_module("stepweave.catalog.registry")
