"""Registered queries and their SQL counterparts, by area."""

import importlib

from annograph.catalog.registry import ORACLES, QUERIES

for _area in ("validation", "planning", "documents", "graph", "links", "edits", "images", "streams"):
    importlib.import_module(f"annograph.catalog.{_area}")

__all__ = ["ORACLES", "QUERIES"]
