"""Registration of queries, and how results are made comparable between engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf: comparable(build(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def comparable(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, reals as DOUBLE rounded to six digits."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: str) -> str:
    """SQL for a rounded real; adding zero turns -0.0 into 0.0."""
    return f"(ROUND(CAST({x} AS DOUBLE), {DIGITS}) + 0e0)"


def text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def sql(ctes: list[str], select: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select
