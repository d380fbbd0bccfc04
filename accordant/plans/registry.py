"""The registered queries, each with the inventory ids it covers and its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable under ``name``."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Entry(name, tuple(ids.split()), fn, sql)
        return fn

    return wrap


def load_all() -> dict[str, Entry]:
    import importlib
    import pkgutil

    import accordant.plans as plans

    for mod in pkgutil.iter_modules(plans.__path__):
        if mod.name.endswith("_queries"):
            importlib.import_module(f"accordant.plans.{mod.name}")
    return REGISTRY
