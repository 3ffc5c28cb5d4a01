"""Registry that ties each operator to its input tables and its check in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.inputs import Inputs
from tidemark.plans.oracle_inputs import with_inputs


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    uses: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Inputs(spark, sf_dir))

    def oracle(self) -> str | None:
        return None if self.sql is None else with_inputs(self.uses, self.sql)


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql, uses)
        return build

    return register
