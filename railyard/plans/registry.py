"""Registry of named queries and their DuckDB oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver test
tables (seen through :mod:`railyard.sources.testviews`). The oracle SQL for the
same name computes the same result in DuckDB from the same tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import SESSION_DEFAULTS
from ..sources.testviews import duck_cte

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle (omit for rows-only checks)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
                spark.conf.set(k, SESSION_DEFAULTS[k])
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


def with_views(views: list[str], body: str) -> str:
    """DuckDB SQL: the named logical views as CTEs, then the body (which may
    continue the WITH list by starting with a comma)."""
    ctes = ",\n".join(duck_cte(v) for v in views)
    if body.lstrip().startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column, so engines agree on the printed digits."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def sql(views: list[str], ctes: list[tuple[str, str]], final: str) -> str:
    """DuckDB SQL from logical views, further named CTEs and a final SELECT."""
    parts = [duck_cte(v) for v in views] + [f'"{n}" AS ({body})' for n, body in ctes]
    if not parts:
        return final
    return "WITH " + ",\n".join(parts) + "\n" + final
