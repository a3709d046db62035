"""The named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorloom.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CTES = {
    "readings": T.READINGS_CTE,
    "weather": T.WEATHER_CTE,
    "points": T.POINTS_CTE,
    "training": T.TRAINING_CTE,
    "enduse": T.ENDUSE_CTE,
}


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle SQL where SQL can say it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_sql(*parts: str, select: str) -> str:
    """``WITH`` named steps (adapter names or ``name AS (...)`` texts) and the final select."""
    return "WITH RECURSIVE " + ",\n".join(_CTES.get(p, p) for p in parts) + "\n" + select


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded double without a negative zero, for comparing engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def rs(expr: str, places: int = 6) -> str:
    """The same as SQL text."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: r(F.col(c).cast("double"), places) for c in columns})
