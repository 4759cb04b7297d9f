"""Registered queries with, where SQL can say it, the same query as ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles on a grid of 1e-6 so two engines can be compared.

    The half is a little more than 0.5: decimals that end in an exact 5 would
    otherwise fall either way by their last bit.  Adding 0.0 folds -0.0.
    """
    cols = {n: F.floor(F.col(n).cast("double") * F.lit(1e6) + F.lit(0.5000001)) / F.lit(1e6) + F.lit(0.0) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(cols)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` names the columns the SQL side rounds alike."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        if sql is not None:
            cols = doubles.split()
            if cols:
                repl = ", ".join(f"floor({c} * 1e6 + 0.5000001e0) / 1e6 + 0e0 AS {c}" for c in cols)
                SQL[name] = f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"
            else:
                SQL[name] = sql
        return fn

    return wrap
