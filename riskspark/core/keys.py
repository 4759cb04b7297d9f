"""Null-safe joins on key columns and small column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a NULL key meets a NULL key; keeps the left key columns."""
    keys = list(keys)
    if not keys:
        if how in ("left_semi", "left_anti"):
            return left.join(right, F.lit(True), how)
        return left.join(right, F.lit(True), "left" if how == "left" else "inner")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def finite(c: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN becomes NULL in the named (default: all) floating columns."""
    names = list(cols) if cols is not None else [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when the denominator is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))
