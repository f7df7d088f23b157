"""The query catalogue: name -> (callable on (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated callable under name, with its SQL oracle where SQL can express it."""

    def put(f: Query) -> Query:
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")
        CATALOGUE[name] = (f, sql)
        return f

    return put


def load() -> dict[str, tuple[Query, str | None]]:
    """The whole catalogue, with every module of adlens.plans imported."""
    import importlib
    import pkgutil

    import adlens.plans as plans

    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__)):
        importlib.import_module(f"adlens.plans.{m}")
    return CATALOGUE
