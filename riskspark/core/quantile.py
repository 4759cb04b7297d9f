"""Exact interpolated quantiles of large groups from running counts.

The built-in exact percentile keeps all distinct values of a group in one
buffer; here the values stay rows, so a hot key spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import join_on
from .order import place_rows, running


def quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: dict[str, float],
    *,
    n: str = "n",
    measure: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of (keys, value, count) rows."""
    keys = list(keys)
    order = [F.col(value).asc()]
    placed, place = place_rows(counts, keys, order, measure=measure, limit=limit)
    cum = running(placed, keys, order, {"__upto": ("sum", F.col(n))}, place)
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__n"))
    both = join_on(cum, total, keys)
    aggs: list[Column] = []
    for name, q in qs.items():
        h = F.lit(float(q)) * (F.col("__n") - 1)
        lo = F.min(F.when(F.col("__upto") >= F.floor(h) + 1, F.col(value)))
        hi = F.min(F.when(F.col("__upto") >= F.ceil(h) + 1, F.col(value)))
        frac = F.max(h - F.floor(h))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return both.groupBy(*keys).agg(*aggs)
