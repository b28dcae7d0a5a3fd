"""Registry of runnable queries: name -> Spark callable and, where SQL can say it, check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None = None


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}

    def add(self, name: str, run: Run, sql: str | None = None) -> None:
        if name in self._queries:
            raise ValueError(f"query {name} is registered twice")

        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        self._queries[name] = Query(name, prepared, sql)

    def callables(self) -> dict[str, Run]:
        return {q.name: q.run for q in self._queries.values()}

    def checks(self) -> dict[str, str]:
        return {q.name: q.sql for q in self._queries.values() if q.sql is not None}
