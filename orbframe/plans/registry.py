"""Where queries and their SQL equivalents are collected."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` gives the same result in DuckDB."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(col, places: int = 6):
    """Rounded for comparison; adding zero removes a negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, places) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, places) for n in names})
