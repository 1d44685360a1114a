"""End-to-end compositions and the registered queries."""

from importlib import import_module

THEMES = ("q_flows", "q_alerts", "q_board", "q_sources", "q_detect")


def load_catalog():
    """Import every theme module and return the registry they filled."""
    for theme in THEMES:
        import_module(f"flowspark.plans.{theme}")
    return import_module("flowspark.plans.catalog")
