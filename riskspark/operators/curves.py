"""Curve bands: per-split curves on a common grid, summarised over splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .dca import band, interpolate_to_grid
from .hist import clean_scores, points_of

GRID_120 = [i / 119 for i in range(120)]


def _valid(df: DataFrame, keys: Sequence[str], y: str, p: str, limit: int | None) -> DataFrame:
    return points_of(df, keys, y, p, limit=limit).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def _starts(df: DataFrame, keys: Sequence[str], y: str, p: str, v: float) -> DataFrame:
    """First point of the curve of every key with both classes; read from the rows, not from their ordered points."""
    label = F.col(y).cast("bigint")
    both = clean_scores(df, y, p).groupBy(*keys).agg(F.min(label).alias("__a"), F.max(label).alias("__b")).filter("__a = 0 AND __b = 1")
    return both.select(*keys, F.lit(0.0).alias("x"), F.lit(v).alias("v"))


def roc_band(df: DataFrame, keys: Sequence[str], split: str, grid: Sequence[float] = GRID_120, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """ROC curve of each split on a false-positive grid; mean, sd and percentiles over splits."""
    by = [*keys, split]
    pts = _valid(df, by, y, p, limit)
    kept = pts.filter("keep").select(*by, (F.col("fp") / F.col("n_neg")).alias("x"), (F.col("tp") / F.col("n_pos")).alias("v"))
    line = interpolate_to_grid(kept.unionByName(_starts(df, by, y, p, 0.0)), by, "x", "v", grid)
    line = line.withColumn("value", F.when(F.col("grid") == 0, F.lit(0.0)).otherwise(F.col("value")))
    return band(line, [*keys, "grid"], "value")


def pr_band(df: DataFrame, keys: Sequence[str], split: str, grid: Sequence[float] = GRID_120, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Precision-recall curve of each split on a recall grid; mean, sd and percentiles over splits."""
    by = [*keys, split]
    pts = _valid(df, by, y, p, limit)
    line = pts.select(*by, (F.col("tp") / F.col("n_pos")).alias("x"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("v"))
    return band(interpolate_to_grid(line.unionByName(_starts(df, by, y, p, 1.0)), by, "x", "v", grid, falling=True), [*keys, "grid"], "value")
