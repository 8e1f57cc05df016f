"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

import importlib

from trailmesh.catalog.registry import ORACLES, QUERIES

MODULES = ["cleaning", "cells", "stats", "streets", "zones", "routing", "rewards", "archive", "jobs"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"trailmesh.catalog.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
