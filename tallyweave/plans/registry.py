"""Pairs every registered query with the SQL text that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyweave.plans.domain import Domain, with_views
from tallyweave.session import configure


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Domain], DataFrame]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Domain(configure(spark), sf_dir))


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(domain)`` under ``name``; ``oracle`` may use the fx views by name."""

    def add(fn: Callable[[Domain], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, with_views(oracle) if oracle else None)
        return fn

    return add


def load_all() -> dict[str, Entry]:
    from tallyweave.plans import (  # noqa: F401
        catalog_queries,
        evaluation_queries,
        head_queries,
        membership_queries,
        overlay_queries,
        preparation_queries,
        raster_queries,
        scalar_queries,
        stream_queries,
        training_queries,
    )

    return REGISTRY
