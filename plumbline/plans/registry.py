"""Named queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "calibration_bundle"
MODULES = ("scans", "reshaping", "joining", "measuring", "rating", "ranking", "inferring", "resampling", "deciding", "sampling", "wording", "answering", "streams", "stored", "rollups")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name a frame as ``{trials}``, which becomes a subquery."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = frames.expand(sql)
        return f

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"plumbline.plans.{module}")
