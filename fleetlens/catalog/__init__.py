"""The query catalogue: one entry per operator, with its SQL oracle where one exists."""

from importlib import import_module

from fleetlens.catalog.registry import ORACLES, QUERIES

for _module in ("offers", "planning", "scalars", "fleet", "units", "state", "objects", "publish",
                "lifecycle", "health", "polling"):
    import_module(f"fleetlens.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
