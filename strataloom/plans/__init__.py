"""Registered queries: Spark plans with their SQL twins."""

from importlib import import_module

AREAS = ("tabular", "rules", "whole", "text", "extraction", "vectors", "knowledge", "graphs", "scores", "retrieval", "reports", "streams", "stores")


def load_all() -> None:
    """Import every plan module; importing registers its queries."""
    for area in AREAS:
        import_module(f"strataloom.plans.{area}")
