from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmesh.catalog.sqltext import with_ctes
from trailmesh.session import in_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Registers ``fn(data)``; ``data`` gives the derived tables of one scale folder."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from trailmesh.catalog.fixtures import Data

            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return in_utc(fn(Data(spark, sf_dir)))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_ctes(sql, extra or {})
        return fn

    return add
