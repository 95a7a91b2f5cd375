"""Registered queries: each pairs a Spark plan over the given tables with a SQL twin."""

import importlib

FAMILIES = ("projections", "filters", "joins", "aggregates", "windows", "scalars", "quality", "supply", "manufacturing", "labour", "files")


def load_all():
    """Import every family of plans; returns the plans and the SQL twins by key."""
    for family in FAMILIES:
        importlib.import_module(f"orebook.plans.{family}")
    from orebook.plans.registry import PLANS, TWINS

    return PLANS, TWINS
