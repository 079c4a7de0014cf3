"""Registry of the queries the driver runs (Spark plan + DuckDB twin)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Registered:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str  # SURVEY operator ids covered


_REGISTRY: dict[str, Registered] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in _REGISTRY:
            raise KeyError(f"duplicate query {name}")
        _REGISTRY[name] = Registered(name, fn, sql, ids)
        return fn

    return wrap


def _load_all():
    # importing the modules registers their queries
    from pairforge.plans import (  # noqa: F401
        q_text, q_metrics, q_prepare, q_evallog, q_rollout, q_codebleu, q_misc, q_helpers, q_readers)


def registry() -> dict[str, Registered]:
    _load_all()
    return dict(_REGISTRY)
