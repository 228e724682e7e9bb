"""Queries that run each operator on the given tables, with SQL to check them."""

FAMILIES = ("caliper", "casts", "clusters", "curves", "records")


def load():
    """Import every family and return the registry."""
    from importlib import import_module

    for family in FAMILIES:
        import_module(f"plumbline.workload.{family}")
    return import_module("plumbline.workload.registry")
