"""Queries over the driver's tables, one module per family of operators."""

from importlib import import_module

MODULES = ["scalar", "cases", "relational", "catalogue", "aggregates", "retrieval", "evaluation", "extraction", "streams"]


def load():
    from waymark.plans import registry

    for name in MODULES:
        import_module(f"waymark.plans.{name}")
    return registry.QUERIES, registry.ORACLES
