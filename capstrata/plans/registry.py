"""Registered queries: a name, a plan over the views, and optionally the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from capstrata.plans.views import SQL_VIEWS, Views


@dataclass
class Query:
    name: str
    plan: Callable[[Views], DataFrame]
    sql: str | None = None
    uses: list[str] = field(default_factory=list)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Views(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        ordered: list[str] = []

        def need(name: str) -> None:
            deps, _ = SQL_VIEWS[name]
            for d in deps:
                need(d)
            if name not in ordered:
                ordered.append(name)

        for name in self.uses:
            need(name)
        parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered] + [f"answer AS ({self.sql})"]
        return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT * FROM answer"


QUERIES: dict[str, Query] = {}


def query(name: str, *uses: str, sql: str | None = None):
    def add(plan):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, plan, sql, list(uses))
        return plan
    return add


def r6(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5003) / 1e6)"


def r3(expr: str) -> str:
    return f"(floor(({expr}) * 1e3 + 0.5003) / 1e3)"
