"""Evaluation of one split: metric row, thresholds, clinical points, control specificities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..core.keys import join_on
from ..functions.scalar import adjust_prevalence
from ..operators.calibration import calibration_line, ece
from ..operators.discrimination import discrimination, error_metrics
from ..operators.thresholds import choose_threshold, confusion_at, multi_specificity, top_risk_capture


def with_target_prevalence(df: DataFrame, target: float, keys: Sequence[str] = (), train_split: str = "TRAIN", y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Scores moved from the training prevalence of their key to the target."""
    prev = df.filter(F.col("split") == train_split).groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("__prev"))
    rows = join_on(df, prev, list(keys), "left")
    return rows.withColumn("y_prob_adjusted", adjust_prevalence(p, F.col("__prev"), F.lit(float(target)))).drop("__prev")


def evaluate_split(df: DataFrame, keys: Sequence[str] = ("model",), split: str = "TEST", threshold_split: str = "VAL", y: str = "y_true", *, limit: int | None = None) -> DataFrame:
    """Metric row per key on the adjusted scores of one split, with the confusion at the threshold chosen on another."""
    keys = list(keys)
    p = "y_prob_adjusted" if "y_prob_adjusted" in df.columns else "y_prob"
    test = df.filter(F.col("split") == split)
    out = join_on(discrimination(test, keys, y, p, limit=limit), error_metrics(test, keys, y, p), keys)
    out = join_on(out, ece(test, keys, 10, y, p), keys, "left")
    out = join_on(out, calibration_line(test, keys, y, p), keys, "left")
    thr = choose_threshold(df.filter(F.col("split") == threshold_split), keys, None, y, p, limit=limit)
    at = confusion_at(test, thr, keys, y, p).select(*keys, "threshold", "precision", "sensitivity", "specificity", "f1")
    return join_on(out, at, keys, "left")


def holdout_report(df: DataFrame, keys: Sequence[str] = ("model",), clinical: Sequence[float] = (0.01, 0.05, 0.1), specificities: Sequence[float] = (0.9, 0.95, 0.99), fracs: Sequence[float] = (0.01, 0.05, 0.1), id_col: str = "id", y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Long table of holdout figures: clinical thresholds, control specificities and top-fraction capture."""
    keys = list(keys)
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(float(c)) for c in clinical])).alias("threshold"))
    parts = [
        confusion_at(df, grid, keys, y, p).select(*keys, F.lit("clinical").alias("kind"), F.col("threshold").alias("at"), "sensitivity", F.col("specificity").alias("other")),
        multi_specificity(df, specificities, keys, y, p, limit=limit).select(*keys, F.lit("control_spec").alias("kind"), F.col("target_spec").alias("at"), "sensitivity", F.col("specificity").alias("other")),
        top_risk_capture(df, fracs, keys, id_col, y, p, limit=limit).select(*keys, F.lit("top_fraction").alias("kind"), F.col("frac").alias("at"), F.col("case_capture").alias("sensitivity"), (F.col("cases_in_top") / F.col("n_top")).alias("other")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
