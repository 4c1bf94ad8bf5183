"""Registered queries: each module applies operators to views over the driver tables."""

from importlib import import_module

MODULES = ("projections", "aggregates", "joins", "ordering", "graphs", "retrieval", "scanning", "merging", "texts", "streams", "code")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
