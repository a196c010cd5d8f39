"""Queries over the test tables, each with the same question in SQL."""

import importlib

from checks.registry import ORACLES, QUERIES

for _module in ("page_queries", "endpoint_queries", "spec_queries"):
    importlib.import_module(f"checks.{_module}")

__all__ = ["ORACLES", "QUERIES"]
