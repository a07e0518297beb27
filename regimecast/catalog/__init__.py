"""All registered queries, grouped by topic."""

from __future__ import annotations

import importlib

TOPICS = ("scalars", "series", "regimes", "clusters", "evaluation", "models")


def load():
    """Import every topic and return the registry module."""
    for topic in TOPICS:
        importlib.import_module(f"regimecast.catalog.{topic}")
    return importlib.import_module("regimecast.catalog.registry")
