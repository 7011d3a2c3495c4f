"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Plan], Plan]:
        """Registers a plan under its function's name."""

        def register(plan: Plan) -> Plan:
            self.queries[plan.__name__] = plan
            if sql:
                self.sql[plan.__name__] = sql
            return plan

        return register
