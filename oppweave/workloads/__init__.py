"""Queries and DuckDB twins on the test tables, one module per area."""

from importlib import import_module

AREAS = ["matching", "hits", "pages", "claims", "rounds", "plans"]


def load() -> None:
    """Import every area so that its queries register."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
