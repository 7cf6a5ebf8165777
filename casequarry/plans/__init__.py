"""Whole reviews, and the registered queries."""

from importlib import import_module

MODULES = ["queries_intake", "queries_model", "queries_checks", "queries_report", "queries_stream"]


def load_all() -> None:
    """Import the query modules; each registers its queries."""
    for name in MODULES:
        import_module(f"casequarry.plans.{name}")
