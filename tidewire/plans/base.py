"""The registry: each query names its columns and types once; both engines' results are cast to them, so that they agree on types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.views import NOW, Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_DUCK = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

DAY = f"date_trunc('day', {NOW})"


def AGO(part: str) -> str:  # noqa: N802  reads as a constant in the SQL texts
    return f"{NOW} - INTERVAL {part}"


def add(name: str, schema: str, build: Callable[[Views], DataFrame], body: str | None = None, *views: str) -> None:
    cols = [c.split() for c in schema.split(", ")]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(Views(spark, sf_dir))
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in cols])

    query.__name__ = name
    QUERIES[name] = query
    if body:
        SQL[name] = "SELECT " + ", ".join(f"CAST({c} AS {_DUCK[t]}) AS {c}" for c, t in cols) + " FROM (" + with_views(body, views) + ")"
