"""Operators for preparing training text: language, duplicates, leaks, rules, tokens.

Nothing outside this package imports it. ``catalog`` registers its queries.

Python workers import these modules by name. On a cluster the package is shipped like any other
(``--py-files``); where driver and workers share a file system, the folder it was imported from is
added to their path here, so that a driver started anywhere can use it.
"""

import os
from pathlib import Path

from pyspark import SparkContext

_ROOT = str(Path(__file__).resolve().parents[2])


def _joined(paths: str) -> str:
    held = [p for p in paths.split(os.pathsep) if p]
    return paths if _ROOT in held else os.pathsep.join([_ROOT, *held])


def reach_workers(context: SparkContext | None) -> None:
    """Let workers that are started from now on find this package."""
    if context is not None:
        context.environment["PYTHONPATH"] = _joined(context.environment.get("PYTHONPATH", ""))


os.environ["PYTHONPATH"] = _joined(os.environ.get("PYTHONPATH", ""))
reach_workers(SparkContext._active_spark_context)
