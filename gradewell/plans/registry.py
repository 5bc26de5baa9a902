"""Named queries: a Spark callable over a data folder and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gradewell.plans.fixtures import Fixtures, oracle


@dataclass(frozen=True)
class Query:
    build: Callable[[Fixtures], DataFrame]
    sql: str | None
    fixtures: type[Fixtures] = Fixtures

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(self.fixtures(spark, folder))


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def query(self, name: str, views: str = "", sql: str | None = None):
        """Register the decorated function of one ``Fixtures`` argument under ``name``."""
        def register(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = Query(build, oracle(views, sql) if sql else None)
            return build
        return register


CATALOG = Catalog()


def load_catalog() -> Catalog:
    """Import every plan module once so that it registers its queries."""
    from gradewell.plans import (  # noqa: F401
        decisions, dedup, evaluation, features, ingest, modelling, profiling, ranking, resolve, sessions, splits, whole_files,
    )
    return CATALOG
