"""Registry of named queries: a Spark builder plus (optionally) the
equivalent DuckDB SQL used as an oracle.

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame that
reads the whole input tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doc: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def all_queries() -> dict[str, QuerySpec]:
    # importing the query modules fills the registry
    from . import queries  # noqa: F401
    return REGISTRY
