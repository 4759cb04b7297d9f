"""Ranking and error metrics of scored tables, for all key groups in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.keys import finite, join_on, ratio
from ..functions.scalar import clip
from .hist import clean_scores, points_of


def _tpr() -> Column:
    return ratio(F.col("tp"), F.col("n_pos"))


def _fpr() -> Column:
    return ratio(F.col("fp"), F.col("n_neg"))


def two_classes() -> Column:
    """Group condition: both classes present."""
    return (F.max("n_pos") > 0) & (F.max("n_neg") > 0)


def auroc_agg() -> Column:
    """Ties count half: positives beat the negatives scored strictly below."""
    beaten = F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / F.lit(2.0))
    return F.when(two_classes(), F.sum(beaten) / (F.max("n_pos").cast("double") * F.max("n_neg")))


def prauc_agg() -> Column:
    """Step-wise average precision."""
    step = F.col("pos") / F.col("n_pos").cast("double") * (F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    return F.when(two_classes(), F.sum(F.when(F.col("n_pos") > 0, step)))


def youden_agg() -> Column:
    return F.when(two_classes(), F.greatest(F.lit(0.0), F.max(_tpr() - _fpr())))


def sens_at_spec_agg(target: float = 0.95) -> Column:
    """Best sensitivity among kept curve points with enough specificity; the start point gives 0."""
    ok = F.col("keep") & ((F.lit(1.0) - _fpr()) >= F.lit(target))
    return F.when(two_classes(), F.coalesce(F.max(F.when(ok, _tpr())), F.lit(0.0)))


def tpr_at_fpr_agg(target: float = 0.05) -> Column:
    ok = F.col("keep") & (_fpr() <= F.lit(target))
    return F.when(two_classes(), F.coalesce(F.max(F.when(ok, _tpr())), F.lit(0.0)))


# Metric name -> aggregate over curve points; the bootstrap uses the same table.
CURVE_METRICS = {
    "auroc": auroc_agg,
    "prauc": prauc_agg,
    "youden": youden_agg,
    "sens_at_spec": sens_at_spec_agg,
    "tpr_at_fpr": tpr_at_fpr_agg,
}


def curve_metrics(points: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*[CURVE_METRICS[n]().alias(n) for n in names])


def _single(name: str):
    def op(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", **kw) -> DataFrame:
        points = points_of(df, keys, y, p, limit=kw.pop("limit", None))
        return points.groupBy(*keys).agg(CURVE_METRICS[name](**kw).alias(name))

    op.__name__ = name
    op.__doc__ = f"{name} per key group; NULL when a group has one class."
    return op


auroc = _single("auroc")
prauc = _single("prauc")
youden_j = _single("youden")
sens_at_spec = _single("sens_at_spec")
tpr_at_fpr = _single("tpr_at_fpr")


def brier_agg(y: str = "y_true", p: str = "y_prob") -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def log_loss_agg(y: str = "y_true", p: str = "y_prob", eps: float = 1e-15) -> Column:
    q = clip(F.col(p).cast("double"), eps, 1.0 - eps)
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(F.lit(1.0) - q)))


def error_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Brier score and log loss."""
    return clean_scores(df, y, p).groupBy(*keys).agg(
        brier_agg(y, p).alias("brier"), log_loss_agg(y, p).alias("log_loss")
    )


def discrimination(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", target_spec: float = 0.95, *, limit: int | None = None) -> DataFrame:
    """AUROC, AP, Youden J and sensitivity at a specificity in one pass."""
    points = points_of(df, keys, y, p, limit=limit)
    return points.groupBy(*keys).agg(
        auroc_agg().alias("auroc"), prauc_agg().alias("prauc"), youden_agg().alias("youden"),
        sens_at_spec_agg(target_spec).alias("alpha"),
    )


def preferred_score(df: DataFrame) -> str:
    """Pooled metrics use the adjusted score, then the raw one, then risk_score."""
    for name in ("y_prob_adjusted", "y_prob", "risk_score"):
        if name in df.columns:
            return name
    raise ValueError("no score column among y_prob_adjusted, y_prob, risk_score")


def pooled_metrics(df: DataFrame, keys: Sequence[str] = ("model",), y: str = "y_true", targets: Sequence[float] = (0.9, 0.95), *, limit: int | None = None) -> DataFrame:
    """Discrimination, Brier, counts and sensitivity at several specificities on pooled rows."""
    p = preferred_score(df)
    points = points_of(df, keys, y, p, limit=limit)
    extra = [sens_at_spec_agg(t).alias(f"sens_at_spec_{int(round(t * 100))}") for t in sorted(targets)]
    ranked = points.groupBy(*keys).agg(
        auroc_agg().alias("auroc"), prauc_agg().alias("prauc"), youden_agg().alias("youden"), *extra
    )
    plain = clean_scores(df, y, p).groupBy(*keys).agg(
        brier_agg(y, p).alias("brier"),
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.col(y).cast("bigint")).alias("n_positive"),
        F.avg(F.col(y).cast("double")).alias("prevalence"),
    )
    return join_on(plain, ranked, keys)


def score_by_group(df: DataFrame, keys: Sequence[str], group: str = "category", p: str = "y_prob") -> DataFrame:
    """Mean score per case type."""
    return df.filter(finite(F.col(p))).groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score")
    )


def roc_points(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """ROC curve after pruning, without the artificial start point."""
    pts = points_of(df, keys, y, p, limit=limit).filter("keep")
    return pts.select(*keys, F.col("p").alias("threshold"), ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def pr_points(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score."""
    pts = points_of(df, keys, y, p, limit=limit)
    return pts.select(*keys, F.col("p").alias("threshold"), ratio(F.col("tp"), F.col("n_pos")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
