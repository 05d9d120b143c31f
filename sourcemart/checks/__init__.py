"""Registered queries over the star-schema tables, each beside its SQL twin where SQL can say the same."""

from importlib import import_module

from sourcemart.checks.base import REGISTRY

for _name in ("scalars", "filters", "joins", "aggregates", "ranking", "intake", "cells", "overlays", "retrieval",
              "sessions", "streams", "governance"):
    import_module(f"sourcemart.checks.{_name}")

__all__ = ["REGISTRY"]
