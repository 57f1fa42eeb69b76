"""Where queries are registered, with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, days: tuple[str, ...] = ()):
    """Register a query; ``days`` are its columns of type date, which both sides give as text."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(spark, folder).withColumns({c: F.col(c).cast("string") for c in days})

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in days)}) FROM ({sql})" if days else sql
        return f

    return add
